"""String functions of the graph model, as column expressions, and the few that need Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def node_id(package: Column, workspace: Column, file_path: Column, qualified: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(package, F.lit("")), workspace), F.lit("/"), file_path, F.lit("::"), qualified)


def specifier_package(s: Column) -> Column:
    """The package of an import specifier: the first segment, or two of a scoped one; a scope alone is returned whole."""
    return F.regexp_extract(s, "^(@[^/]+/[^/]+|[^/]*)", 1)


def specifier_subpath(s: Column) -> Column:
    return F.regexp_extract(s, "^(?:@[^/]+/[^/]+|[^@/][^/]*)/(.*)$", 1)


def package_dir(path: Column) -> Column:
    """The directory of the package that a file is in: packages, apps, libs or services with the next segment, else internal, cmd or pkg with it; else empty."""
    a = F.regexp_extract(path, "^(.*?(?:^|/)(?:packages|apps|libs|services)/[^/]+)/", 1)
    b = F.regexp_extract(path, "^(.*?(?:^|/)(?:internal|cmd|pkg)/[^/]+)/", 1)
    return F.when(a != "", a).otherwise(b)


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def normal_path(path: Column) -> Column:
    """A path without '.', empty segments and, as far as there is something before them, '..': of any depth."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def clean_symbol(symbol: Column) -> Column:
    """The local name of an imported symbol: x of `* as x`."""
    return F.regexp_replace(symbol, r"^\* as ", "")


def entry_root(path: Column) -> Column:
    """A package's entry point without its src, lib or dist directory and what follows."""
    return F.regexp_replace(path, "/(?:src|lib|dist)(?:/.*)?$", "")


def join_parts(*parts: Column) -> Column:
    """Parts that are not empty, one a line: signature, docstring, source."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def body_hash(source: Column) -> Column:
    return F.sha2(source, 256)


def fallback_tokens(text: Column, per: int = 4) -> Column:
    """Tokens by bytes, where no vocabulary is at hand."""
    return F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / per).cast("long")


def truncate_input(signature: str, docstring: str, source: str, encode, decode, limit: int = 8191) -> tuple[str, int, bool]:
    """(text, tokens, truncated): what is embedded of a symbol. Beyond the limit the source is cut first, signature and
    docstring stay; if they alone exceed it, the whole is cut."""
    text = "\n".join(p for p in (signature, docstring, source) if p)
    tokens = encode(text)
    if len(tokens) <= limit:
        return text, len(tokens), False
    head = "\n".join(p for p in (signature, docstring) if p)
    used = len(encode(head))
    if used >= limit:
        return decode(tokens[:limit]), limit, True
    body = encode(source)[: limit - used]
    return "\n".join(p for p in (head, decode(body)) if p), used + len(body), True


# The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980).
_V = "[aeiou]|(?<=[^aeiou])y"
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _shape(w: str) -> str:
    return "".join("v" if c in "aeiou" or (c == "y" and i and w[i - 1] not in "aeiou") else "c" for i, c in enumerate(w))


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((_STEP2, 0), (_STEP3, 0)):
        for end, new in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > least:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            head = w[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
