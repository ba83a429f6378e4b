"""HTML extraction: a tree builder with implied tags, and a renderer of all visible text.

The builder accepts what browsers accept: tags that are never closed, cells without rows, stray end
tags. Whatever can't stand in a head ends it: text, or the start tag of an element of the body. A tag that the end of the page
cuts off is dropped. The renderer walks the tree without recursion. Blocks start on a line of their own, paragraphs, headings, lists
and tables are set apart by an empty line, list items have markers and indentation, preformatted text keeps its
spaces, and the cells of a table are aligned in columns, those that span rows or columns included. Not visible: the head, scripts, styles, templates,
comments, elements with `hidden`, those styled display:none, and the text of those styled visibility:hidden but not of elements
within that are visible again.

A column starts two characters behind the longest line that has it to its right. Such lines are wrapped at spaces after `wrap`
characters; a word that is longer sticks out and moves what is right of it. The last cell of a row is never wrapped. So a
table takes at most `wrap` characters of padding for each of its cells' lines.

Defined cases. Null markup gives null, empty markup empty text. Text without tags is text. Repeated rows
are rendered alike. Any depth of nesting is accepted. Very long pages: the scan is linear. Spans above 1,000 count as 1,000.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from .common import per_text, read

WRAP = 80

#: Element names of the HTML standard by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head title meta link script style template noscript iframe object audio video canvas svg math datalist noembed noframes".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li legend main menu nav ol p pre search section summary table ul caption thead tbody tfoot tr td th option optgroup".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table pre blockquote figure hr".split())
#: What a start tag closes, if it is open: (closed elements, elements beyond which it does not look).
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Elements that may stand in a head.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
_SCOPE = frozenset(["table", "td", "th", "caption", "html", "button"])

#: A tag without its "<" and ">"; possessive, so a scan is linear.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_SPAN = re.compile(r"\s*0*([1-9]\d{0,8})")
_WHITE = re.compile(r"[ \t\n\r\f]+")
_LIST = frozenset(["ul", "ol", "menu", "dir"])


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attr(self, name: str) -> str | None:
        if name in self.attrs.lower():
            for m in _ATTR.finditer(self.attrs):
                if m[1].lower() == name:
                    return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def parse(markup: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, counts = [root], {}
    at, n = 0, len(markup)

    def pop_to(k: int) -> None:
        for node in stack[k:]:
            counts[node.tag] -= 1
        del stack[k:]

    def close(tags: frozenset, scope: frozenset) -> None:
        """Closes the outermost open element of tags above the nearest one of scope."""
        if not any(counts.get(t) for t in tags):
            return
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                found = k
            elif stack[k].tag in scope:
                break
        if found:
            pop_to(found)

    def say(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                pop_to(len(stack) - 1)
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < n:
        lt = markup.find("<", at)
        if lt < 0:
            say(markup[at:])
            break
        after = markup[lt + 1 : lt + 3]
        if after[:1] in ("!", "?") or after[:1] == "/" and not after[1:].isalpha():
            say(markup[at:lt])
            if markup.startswith("<!--", lt):
                end = lt + 5 if markup.startswith("<!-->", lt) else lt + 6 if markup.startswith("<!--->", lt) else markup.find("-->", lt + 4) + 3
                at = end if end > lt else n
            else:
                at = markup.find(">", lt) + 1 or n
            continue
        if not (after[:1] == "/" or after[:1].isalpha() and after[:1].isascii()):
            end = lt + 1
            while markup.startswith("<", end):
                end += 1
            if markup[end : end + 1].isalpha() or markup[end : end + 1] in ("/", "!", "?"):
                end -= end > lt + 1
            say(markup[at:end])
            at = end
            continue
        m = _TAG.match(markup, lt + 1)
        if not m:  # cut off by the end of the page
            say(markup[at:lt])
            break
        say(markup[at:lt])
        at = m.end()
        closed = m[3].endswith("/")
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not counts.get("p"):
                stack[-1].children.append(Node("p"))
            elif counts.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                        break  # an end tag inside a cell closes nothing outside it
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD and tag != "html":
            pop_to(len(stack) - 1)
            if tag == "head":
                continue
        if tag in BLOCKS and counts.get("p"):
            close(frozenset(["p"]), _SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("html", "body") and counts.get(tag):
            continue
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(markup, at)
            inner = markup[at : end.start() if end else n]
            at = end.end() if end else n
            if inner:
                node.children.append(html.unescape(inner) if tag in ("title", "textarea") else inner)
        elif tag not in VOID and not (closed and tag in ("svg", "math")):
            stack.append(node)
            counts[tag] = counts.get(tag, 0) + 1
    return root


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    low = node.attrs.lower()
    if not low:
        return False
    if "hidden" in low and (node.attr("hidden") is not None or node.tag == "input"):
        return True
    return "style" in low and bool(_NO_DISPLAY.search(node.attr("style") or ""))


def visibility(node: Node) -> bool | None:
    """Whether the element's style makes its text visible or not; None if it says nothing."""
    m = _VISIBILITY.search(node.attr("style") or "") if "visibility" in node.attrs.lower() else None
    return None if m is None else m[1].lower() == "visible"


def span(node: Node, name: str) -> int:
    m = _SPAN.match(node.attr(name) or "")
    return min(int(m[1]), 1000) if m else 1


class Lines:
    """Output lines of a flow: collapses spaces, keeps the breaks that blocks ask for."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""

    def flush(self) -> None:
        if self.now:
            lead = "".join(self.indent)
            if self.mark:
                lead, self.mark = lead[: -len(self.mark)] + self.mark, ""
            self.done.append(lead + "".join(self.now))
            self.now = []
        self.space = False

    def block(self, apart: bool) -> None:
        self.flush()
        if self.done:
            self.gap = max(self.gap, 1 if apart else 0)

    def put(self, text: str) -> None:
        if self.gap and self.done and self.done[-1]:
            self.done.append("")
        self.gap = 0
        self.now.append(text)

    def words(self, text: str) -> None:
        parts = _WHITE.split(text)
        if parts[0] == "" and self.now:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            self.put((" " if self.space and self.now else "") + body)
            self.space = parts[-1] == ""

    def line(self, text: str) -> None:
        """A line as it is."""
        self.put(text)
        self.flush()

    def lines(self) -> list[str]:
        self.flush()
        return self.done


def wrapped(line: str, wrap: int) -> list[str]:
    """The line cut at spaces, so that no part is longer than `wrap` but single words."""
    out = []
    while len(line) > wrap:
        least = len(line) - len(line.lstrip(" "))
        cut = line.rfind(" ", least + 1, wrap + 1)
        if cut < 0:
            cut = line.find(" ", max(wrap, least + 1))
        if cut < 0:
            break
        out.append(line[:cut])
        line = line[cut + 1 :]
    return [*out, line]


def table_lines(rows: list[list[tuple[list[str], int, int]]], wrap: int) -> list[str]:
    """Rows of cells (lines, columns, rows) in columns."""
    grid: list[list[tuple[int, list[str]]]] = []
    held: dict[int, int] = {}  # column -> rows for which a cell from above still takes it
    for row in rows:
        placed, k = [], 0
        for lines, across, down in row:
            while held.get(k):
                k += 1
            placed.append((k, lines))
            for c in range(k, k + across):
                held[c] = max(held.get(c, 0), down)
            k += across
        held = {c: n - 1 for c, n in held.items() if n > 1}
        last = max((i for i, (_, lines) in enumerate(placed) if lines), default=-1)
        grid.append([(k, [x for line in lines for x in wrapped(line, wrap)] if i < last else lines) for i, (k, lines) in enumerate(placed[: last + 1])])
    # Where each column starts: behind the lines of the cells that stand just before it in some row.
    behind: dict[int, dict[int, int]] = {}
    for row in grid:
        for (k, lines), (after, _) in zip(row, row[1:]):
            own = behind.setdefault(after, {})
            own[k] = max(own.get(k, 0), max((len(x) for x in lines if len(x) <= wrap), default=0))
    starts: dict[int, int] = {}
    at = 0
    for k in sorted({k for row in grid for k, _ in row}):
        at = starts[k] = max([at, *(starts[j] + n + 2 for j, n in behind.get(k, {}).items())])
    out = []
    for row in grid:
        for i in range(max((len(lines) for _, lines in row), default=0)):
            line = ""
            for k, lines in row:
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts[k]) if not line or len(line) + 2 <= starts[k] else line + "  "
                    line += lines[i]
            out.append(line.rstrip())
    return out


def render(root: Node, wrap: int = WRAP) -> str:
    """All visible text of a tree."""
    out = Lines()
    flows: list[Lines] = []  # of the cells around
    tables: list[list] = []
    lists: list[list] = []
    pre = 0
    shown: list[tuple[Node, bool]] = [(root, True)]  # elements that set the visibility of their text
    work: list = [root]
    while work:
        x = work.pop()
        if isinstance(x, str):
            if not shown[-1][1]:
                continue
            if pre:
                first, *more = x.replace("\r\n", "\n").split("\n")
                if first:
                    out.put(first)
                for s in more:
                    if out.now:
                        out.flush()
                    elif out.done:
                        out.done.append("")
                    if s:
                        out.put(s)
            else:
                out.words(x)
            continue
        if isinstance(x, Node):
            tag = x.tag
            if tag == "br":
                if out.now:
                    out.flush()
                elif out.done and out.done[-1]:
                    out.gap = 1
                continue
            if tag == "input" or hidden(x):
                continue
            if (seen := visibility(x)) is not None:
                shown.append((x, seen))
            if tag in BLOCKS and tag not in ("td", "th", "tr"):
                out.block(tag in APART and not (tag in _LIST and lists))
            if tag == "li":
                kind = lists[-1] if lists else ["ul", 0]
                kind[1] += 1
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                out.indent.append(" " * len(mark))
                out.mark = mark
            elif tag in _LIST:
                start = x.attr("start") if tag == "ol" else None
                lists.append([tag, int(start) - 1 if start and re.fullmatch(r"-?\d{1,9}", start) else 0])
            elif tag in ("blockquote", "dd"):
                out.indent.append("  ")
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th"):
                if tables:
                    flows.append(out)
                    out = Lines()
                else:
                    out.space = True
            elif tag == "q" and shown[-1][1]:
                out.words('"')
            elif tag == "optgroup" and shown[-1][1]:
                out.words(x.attr("label") or "")
                out.block(False)
            work.append((x,))
            work.extend(reversed(x.children))
            continue
        x = x[0]
        tag = x.tag
        if tag in ("td", "th"):
            if tables:
                cell, out = out.lines(), flows.pop()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell, span(x, "colspan"), span(x, "rowspan")))
            if shown[-1][0] is x:
                shown.pop()
            continue
        if tag == "li":
            out.flush()
            out.indent.pop()
            out.mark = ""
        elif tag in _LIST:
            lists.pop()
        elif tag in ("blockquote", "dd"):
            out.flush()
            out.indent.pop()
        elif tag == "pre":
            pre -= 1
        elif tag == "table":
            for s in table_lines(tables.pop(), wrap):
                out.line(s)
        elif tag == "q" and shown[-1][1]:
            out.put('"')
        if shown[-1][0] is x:
            shown.pop()
        if tag in BLOCKS and tag != "tr":
            out.block(tag in APART and not (tag in _LIST and lists))
    return "\n".join(out.lines()).strip("\n")


def extract(markup: str | None, wrap: int = WRAP) -> str | None:
    return None if markup is None else render(parse(markup), wrap)


def extract_text(pages: DataFrame, *, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None, wrap: int = WRAP) -> DataFrame:
    """pages' columns `keep` (all by default) with the visible text of each page."""
    return per_text(pages, html_col, f"`{text_col}` string", lambda: lambda texts: [[extract(t, wrap) for t in texts]], keep)


def query(spark, sf_dir) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
