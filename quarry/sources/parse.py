"""Symbols and their relationships from TypeScript, JavaScript and Go source: a lexer and a bracket scanner,
run over files as a mapInPandas operator. Declarations at the top level (and the methods of classes) become nodes; nested functions do not."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import GO_BUILTIN_TYPES, TS_BUILTIN_TYPES

SCRIPT = (".ts", ".tsx", ".js", ".jsx")
NODE_DDL = "name string, qualified_name string, kind string, signature string, start_line int, end_line int, source_code string, docstring string, body_hash string"
EDGE_DDL = "source string, target string, kind string, line int, symbols array<string>"

_LEX = re.compile(
    r"(?P<doc>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<raw>`(?:\\.|[^`\\])*`?)|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<id>[A-Za-z_$@][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|:=|<-|[^\s])",
    re.S,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = frozenset("export default async abstract declare public private protected static readonly override get set".split())
_NOT_CALLS = frozenset("if for while switch catch return typeof function new await yield throw delete void in of do else case super import func go defer select range struct interface map chan".split()) - {"super"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


@dataclass
class Node:
    name: str
    qualified_name: str
    kind: str
    signature: str
    start_line: int
    end_line: int
    source_code: str
    docstring: str
    body_hash: str


@dataclass
class Edge:
    source: str
    target: str
    kind: str
    line: int
    symbols: list[str] = field(default_factory=list)


class Source:
    def __init__(self, text: str):
        self.text, self.tokens, self.comments = text, [], []
        line, at = 1, 0
        for m in _LEX.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            t = Token(m.lastgroup, m.group(), m.start(), m.end(), line)
            (self.comments if t.kind in ("doc", "line") else self.tokens).append(t)
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.text in _PAIRS:
                stack.append(i)
            elif t.text in (")", "]", "}") and stack:
                if _PAIRS[self.tokens[stack[-1]].text] == t.text:
                    self.close[stack.pop()] = i
                elif len(stack) > 1 and _PAIRS[self.tokens[stack[-2]].text] == t.text:
                    stack.pop()
                    self.close[stack.pop()] = i

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def skip(self, i: int) -> int:
        """The index after the token at i, or after the brackets that open there."""
        return self.close.get(i, i) + 1

    def until(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        while i < end and self.at(i) not in stops:
            i = self.skip(i)
        return min(i, end)

    def angle(self, i: int) -> int:
        """The index after type parameters that start at i, if they do."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            depth += {"<": 1, ">": -1}.get(self.at(i), 0)
            i = self.skip(i)
            if not depth:
                break
        return i

    def docstring(self, start: int) -> str:
        """The comment right before an offset: a /** */ block, or lines of // without a gap."""
        row = self.text.count("\n", 0, start) + 1
        before = [c for c in self.comments if c.end <= start]
        if before and not self.text[before[-1].end : start].strip() and before[-1].kind == "doc":
            body = before[-1].text
            return "\n".join(x for x in (re.sub(r"^\s*\*?\s?", "", x).rstrip() for x in body[2:].lstrip("*").removesuffix("*/").split("\n")) if x).strip() if body.startswith("/**") else ""
        out: list[str] = []
        for c in reversed(before):
            if c.kind != "line" or row - c.line > 1 or self.text[self.text.rfind("\n", 0, c.start) + 1 : c.start].strip():
                break
            out.append(c.text[2:].strip())
            row = c.line
        return "\n".join(reversed(out))

    def node(self, name: str, qualified: str, kind: str, first: int, last: int, signature: str | None = None) -> Node:
        a, b = self.tokens[first].start, self.tokens[last].end
        body = self.text[a:b]
        if signature is None:
            signature = body.partition("{")[0].strip() if "{" in body else body.partition("\n")[0].strip()
        k = first
        while k and self.tokens[k - 1].text in _MODIFIERS:
            k -= 1
        return Node(name, qualified, kind, signature, self.tokens[first].line, self.text.count("\n", 0, b) + 1, body, self.docstring(self.tokens[k].start), hashlib.sha256(body.encode()).hexdigest())

    def calls(self, first: int, last: int) -> Iterator[tuple[str, int]]:
        """Dotted names before parentheses, and JSX components."""
        for i in range(first, last + 1):
            t = self.tokens[i]
            if t.text == "(" and i and self.tokens[i - 1].kind == "id":
                k, name = i - 1, [self.at(i - 1)]
                while self.at(k - 1) in (".", "?.") and self.tokens[k - 2].kind == "id":
                    k -= 2
                    name.insert(0, self.at(k))
                if name[0] == "this":
                    name = name[1:]
                if name and self.at(k - 1) not in (".", "?.", "new", "function", "func") and name[0] not in _NOT_CALLS and not (self.at(self.close.get(i, i) + 1) == "{" and len(name) == 1 and self.at(k - 1) in ("{", "}", ";")):
                    yield ".".join(name), self.tokens[k].line
            elif t.text == "<" and self.at(i - 1) in ("(", "return", "=>", ">", "{", "}", "?", ":", "&", "|", ",") and self.tokens[min(i + 1, len(self.tokens) - 1)].kind == "id" and self.at(i + 1)[:1].isupper() and self.at(i + 2) != ",":
                yield self.at(i + 1), t.line

    def types(self, first: int, last: int, builtins: frozenset[str]) -> Iterator[tuple[str, int]]:
        """Type names of a range of an annotation."""
        for i in range(first, last):
            t = self.tokens[i]
            if t.kind == "id" and t.text not in builtins and self.at(i - 1) != "." and self.at(i + 1) not in (":", "?") and t.text not in ("readonly", "keyof", "typeof", "is", "in", "extends", "func", "map", "chan", "struct", "interface"):
                yield t.text, t.line


def _unquote(s: str) -> str:
    return s.strip("\"'`")


def _contains(nodes: list[Node], path: str) -> list[Edge]:
    """File to symbol and class to method."""
    return [Edge(n.qualified_name.rpartition(".")[0] if n.kind == "method" else path, n.qualified_name, "contains", n.start_line) for n in nodes]


class Script:
    """TypeScript and JavaScript."""

    builtins = frozenset(TS_BUILTIN_TYPES)

    def __init__(self, path: str, text: str):
        self.path, self.s = path, Source(text)
        self.nodes: list[Node] = []
        self.edges: list[Edge] = []

    def parse(self) -> tuple[list[Node], list[Edge]]:
        s, i = self.s, 0
        while i < len(s.tokens):
            i = max(self.statement(i), i + 1)
        return self.nodes, self.edges + _contains(self.nodes, self.path)

    def statement(self, first: int) -> int:
        s, i, default = self.s, first, False
        while s.at(i) in _MODIFIERS:
            default |= s.at(i) == "default"
            i += 1
        word = s.at(i)
        start = first + (1 if s.at(first) == "export" else 0)
        start += 1 if s.at(start) == "default" else 0
        if word == "import" and s.at(i + 1) not in ("(", "."):
            return self.imports(i)
        if word == "function":
            k = i + 1 + (s.at(i + 1) == "*")
            name = s.at(k) if s.tokens[min(k, len(s.tokens) - 1)].kind == "id" else ""
            return self.function(start, s.angle(k + bool(name)), name or "default" if name or default else "", name or ("default" if default else ""), "function")
        if word in ("class", "interface", "enum") or word == "const" and s.at(i + 1) == "enum":
            k = i + 1 + (word == "const")
            named = s.at(k) not in ("{", "extends", "implements")
            name = s.at(k) if named else ("default" if default else "")
            k += named
            body = s.until(k, len(s.tokens), ("{",))
            if not name or body >= len(s.tokens):
                return i + 1
            last = s.close.get(body, len(s.tokens) - 1)
            kind = {"const": "enum"}.get(word, word)
            self.nodes.append(s.node(name, name, kind, start, last))
            self.heritage(name, k, body)
            if kind == "class":
                self.members(name, body + 1, last)
            return last + 1
        if word == "type" and s.tokens[min(i + 1, len(s.tokens) - 1)].kind == "id" and s.at(s.angle(i + 2)) == "=":
            end = self.line_end(s.angle(i + 2) + 1)
            self.nodes.append(s.node(s.at(i + 1), s.at(i + 1), "type_alias", start, end))
            return end + 1
        if word in ("const", "let", "var"):
            name, k = s.at(i + 1), s.until(i + 2, len(s.tokens), ("=", ";"))
            if s.at(k) == "=":
                v = k + 1 + (s.at(k + 1) == "async")
                if s.at(v) == "function":
                    p = s.until(v, len(s.tokens), ("(",))
                    return self.function(i + 1, p, name, name, "function")
                p = s.angle(v)
                arrow = s.until(s.skip(p), min(s.skip(p) + 40, len(s.tokens)), ("=>", ";", "=")) if s.at(p) == "(" else p + 1
                if s.at(arrow) == "=>" and (s.at(p) == "(" or s.tokens[p].kind == "id"):
                    end = s.close.get(arrow + 1, 0) if s.at(arrow + 1) == "{" else self.line_end(arrow + 1)
                    n = s.node(name, name, "function", i + 1, end)
                    n.signature = n.source_code.partition("=>")[0].strip() + " =>"
                    n.docstring = s.docstring(s.tokens[first].start)
                    self.add(n, p, arrow, end)
                    return end + 1
            return s.skip(k)
        return s.skip(i)

    def line_end(self, i: int) -> int:
        """The last token of an expression that ends at a semicolon, or at a line's end outside brackets."""
        s = self.s
        last = i
        while i < len(s.tokens):
            if s.at(i) == ";":
                return i
            if i > last and s.tokens[i].line > s.tokens[last].line and s.at(i) not in (".", "|", "&", "?", ":", "+", "?.") and s.at(last) not in ("=", "|", "&", "=>", "+", ",", "?", ":"):
                return last
            last = s.close.get(i, i)
            i = last + 1
        return min(last, len(s.tokens) - 1)

    def function(self, start: int, params: int, name: str, qualified: str, kind: str) -> int:
        s = self.s
        if s.at(params) != "(" or not name:
            return params + 1
        i = s.skip(params)
        if s.at(i) == ":":
            i += 1
            while i < len(s.tokens) and s.at(i) not in (";", "}"):
                if s.at(i) == "{" and s.at(i - 1) not in (":", "|", "&", "<", ","):
                    break
                i = s.skip(i)
        if s.at(i) != "{":
            return i + 1  # an overload or a declaration
        end = s.close.get(i, len(s.tokens) - 1)
        self.add(s.node(name, qualified, kind, start, end), params, i, end)
        return end + 1

    def add(self, n: Node, params: int, body: int, end: int) -> None:
        self.nodes.append(n)
        self.edges += [Edge(n.qualified_name, c, "calls", line) for c, line in self.s.calls(body, end)]
        seen: set[str] = set()
        k = params
        while k < body:  # annotations follow colons
            if self.s.at(k) == ":":
                stop = next((x for x in range(k + 1, body) if self.s.at(x) in (",", ")", "=", "{", "=>")), body)
                for t, line in self.s.types(k + 1, stop, self.builtins):
                    if t not in seen:
                        seen.add(t)
                        self.edges.append(Edge(n.qualified_name, t, "uses_type", line))
                k = stop
            else:
                k += 1

    def members(self, owner: str, i: int, end: int) -> None:
        s = self.s
        while i < end:
            first = i
            while s.at(i) in _MODIFIERS and s.at(i + 1) not in ("(", "=", ":", ";"):
                i += 1
            i += s.at(i) in ("*", "#")
            p = s.angle(i + 1)
            if s.tokens[i].kind in ("id", "str") and s.at(p) == "(":
                name = _unquote(s.at(i))
                i = max(self.function(first, p, name, f"{owner}.{name}", "method"), i + 1)
            else:
                i = s.skip(i)

    def heritage(self, name: str, i: int, end: int) -> None:
        kind = ""
        while i < end:
            word, t = self.s.at(i), self.s.tokens[i]
            if word in ("extends", "implements"):
                kind = word
            elif kind and t.kind == "id":
                k = i
                while self.s.at(k + 1) == ".":
                    k += 2
                self.edges.append(Edge(name, "".join(self.s.at(x) for x in range(i, k + 1)), kind, t.line))
                i = self.s.angle(k + 1) - 1 if self.s.at(k + 1) == "<" else k
            i = self.s.skip(i)

    def imports(self, i: int) -> int:
        s, k, symbols = self.s, i + 1, []
        k += s.at(k) == "type" and s.at(k + 1) not in ("from", ",")
        while k < len(s.tokens) and s.tokens[k].kind != "str":
            t = s.tokens[k]
            if t.text == "*":
                symbols.append(f"* as {s.at(k + 2)}")
                k += 2
            elif t.kind == "id" and t.text not in ("from", "type"):
                symbols.append(t.text)
                if s.at(k + 1) == "as":
                    k += 2
            elif t.text == ";":
                return k + 1
            k += 1
        if k < len(s.tokens):
            self.edges.append(Edge(self.path, _unquote(s.at(k)), "imports", s.tokens[i].line, symbols))
        return k + 1


class Go:
    builtins = frozenset(GO_BUILTIN_TYPES)

    def __init__(self, path: str, text: str):
        self.path, self.s = path, Source(text)
        self.nodes: list[Node] = []
        self.edges: list[Edge] = []

    def parse(self) -> tuple[list[Node], list[Edge]]:
        s, i = self.s, 0
        while i < len(s.tokens):
            word = s.at(i)
            step = {"import": self.imports, "func": self.function, "type": self.type_block}.get(word)
            i = max(step(i), i + 1) if step else s.skip(i)
        return self.nodes, self.edges + _contains(self.nodes, self.path)

    def imports(self, i: int) -> int:
        s = self.s
        k, end = (i + 2, s.close.get(i + 1, i)) if s.at(i + 1) == "(" else (i + 1, i + 3)
        alias = ""
        while k < end and k < len(s.tokens):
            t = s.tokens[k]
            if t.kind == "id" or t.text in (".", "_"):
                alias = t.text
            elif t.kind in ("str", "raw"):
                path = _unquote(t.text)
                self.edges.append(Edge(self.path, path, "imports", t.line, [alias or path.rpartition("/")[2]]))
                alias = ""
                if s.at(i + 1) != "(":
                    return k + 1
            k += 1
        return end + (s.at(i + 1) == "(")

    def function(self, i: int) -> int:
        s, k, owner = self.s, i + 1, ""
        if s.at(k) == "(":
            end = s.close.get(k, k)
            ids = [s.at(x) for x in range(k + 1, s.until(k + 1, end, ("[",))) if s.tokens[x].kind == "id"]
            owner, k = (ids[-1] if ids else ""), end + 1
        name = s.at(k)
        p = k + 1
        if s.at(p) == "[":
            p = s.skip(p)
        if s.at(p) != "(":
            return k + 1
        body = s.skip(p)
        while body < len(s.tokens) and s.at(body) != "{" and s.tokens[body].line == s.tokens[body - 1].line:
            body = s.skip(body + 1) if s.at(body) in ("interface", "struct") and s.at(body + 1) == "{" else s.skip(body)
        if s.at(body) != "{":
            return body
        end = s.close.get(body, len(s.tokens) - 1)
        n = s.node(name, f"{owner}.{name}" if owner else name, "method" if owner else "function", i, end)
        self.nodes.append(n)
        self.edges += [Edge(n.qualified_name, c, "calls", line) for c, line in s.calls(body, end)]
        seen: set[str] = set()
        names = self.parameter_names(p)
        for t, line in s.types(p + 1, body, self.builtins | names):
            if t not in seen:
                seen.add(t)
                self.edges.append(Edge(n.qualified_name, t, "uses_type", line))
        return end + 1

    def parameter_names(self, p: int) -> frozenset[str]:
        """Identifiers that another identifier, a pointer or a bracket follows within the parameters, or a comma before such."""
        s, out, run = self.s, set(), []
        for k in range(p + 1, s.close.get(p, p)):
            t = s.tokens[k]
            if t.kind == "id" and s.at(k - 1) in ("(", ","):
                run.append(t.text)
                if s.at(k + 1) not in (",", ")", "."):
                    out.update(run)
                    run = []
        return frozenset(out)

    def type_block(self, i: int) -> int:
        s = self.s
        if s.at(i + 1) == "(":
            end, k = s.close.get(i + 1, i + 1), i + 2
            while k < end:
                k = max(self.type_spec(k, k), k + 1)
            return end + 1
        return self.type_spec(i + 1, i)

    def type_spec(self, k: int, first: int) -> int:
        s, name = self.s, self.s.at(k)
        if s.tokens[min(k, len(s.tokens) - 1)].kind != "id":
            return k + 1
        p = k + 1
        if s.at(p) == "[" and s.tokens[min(p + 1, len(s.tokens) - 1)].kind == "id" and s.at(p + 2) != "]":
            p = s.skip(p)
        kind = {"struct": "struct", "interface": "interface"}.get(s.at(p), "type_alias")
        if kind == "type_alias":
            p += s.at(p) == "="
            end = p
            while end + 1 < len(s.tokens) and s.tokens[s.close.get(end, end)].line == s.tokens[s.close.get(end, end) + 1].line if s.close.get(end, end) + 1 < len(s.tokens) else False:
                end = s.close.get(end, end) + 1
            end = s.close.get(end, end)
            text = s.text[s.tokens[k].start : s.tokens[end].end]
            self.nodes.append(s.node(name, name, kind, first, end, "type " + text))
            return end + 1
        end = s.close.get(p + 1, p + 1)
        self.nodes.append(s.node(name, name, kind, first, end, f"type {name} {kind}"))
        x = p + 2
        while x < end:  # embedded: a type alone on its line
            t = s.tokens[x]
            y = x + (t.text == "*")
            while s.at(y + 1) == ".":
                y += 2
            alone = s.tokens[y + 1].line > s.tokens[y].line or y + 1 == end
            if s.tokens[y].kind == "id" and alone and (x == p + 2 or s.tokens[x - 1].line < t.line):
                self.edges.append(Edge(name, s.at(y), "embeds", t.line))
            line = t.line
            while x < end and s.tokens[x].line == line:
                x = s.skip(x)
        return end + 1


def parse_file(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    """Nodes and edges of a file; an unknown extension is an error."""
    if path.endswith(SCRIPT):
        return Script(path, text).parse()
    if path.endswith(".go"):
        return Go(path, text).parse()
    raise ValueError(f"no parser for {path}")


def parse_files(files: DataFrame) -> DataFrame:
    """(file_path, nodes, edges, error) of files (file_path, content); a file that fails has its error and no nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["file_path"], b["content"]):
                try:
                    text = content.decode("utf-8", "replace") if isinstance(content, bytes | bytearray) else content
                    nodes, edges = parse_file(path, text)
                    rows.append((path, [asdict(n) for n in nodes], [asdict(e) for e in edges], None))
                except Exception as x:  # noqa: BLE001 - one file's failure is a row, not the job's end
                    rows.append((path, [], [], str(x)))
            yield pd.DataFrame(rows, columns=["file_path", "nodes", "edges", "error"])

    return files.select("file_path", "content").mapInPandas(run, f"file_path string, nodes array<struct<{_fields(NODE_DDL)}>>, edges array<struct<{_fields(EDGE_DDL)}>>, error string")


def _fields(ddl: str) -> str:
    return ", ".join(x.strip().replace(" ", ": ", 1) for x in ddl.split(","))


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.explode("nodes").alias("n")).select("file_path", "n.*")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.explode("edges").alias("e")).select("file_path", "e.*")


def statistics(parsed: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and edges by kind."""
    n = nodes_of(parsed).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.unionByName(edges_of(parsed).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))
