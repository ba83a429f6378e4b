"""Benchmark decontamination by template windows, in DataFrame functions only.

A text becomes a sequence of lower-case template tokens: names (capitalised words inside a sentence),
numbers and units after numbers become typed placeholders; runs of letters and digits are the
other tokens. Every window of `window` tokens of a benchmark item is indexed by its hash, and a document is
probed at every place, so exactly the tokens of shared runs of `window` tokens are covered, wherever they stand. Items shorter than
`window` are indexed whole. An item has two forms, since its first word is a name to the template once other words stand before it.

A window in which fewer than half the tokens are words of their own would match too much by its placeholders: it is indexed by
its plain tokens instead, with the values in place of the placeholders; so is the only window of an item of fewer than `least` tokens.
Documents are probed with plain tokens too if the benchmark has such windows.

The index is broadcast if its row count, which is checked, is at most `broadcast_rows`, and the items' values if their size,
which is checked, is at most 64 bytes for each of these; beyond
that Spark joins by shuffling. The hits of a document, an item and an alignment must have consistent slots:
equal values of the item must be equal values of the document (a re-parameterised question maps "3" to "7" everywhere; "3" and
"5" may both become "7"). Where a value of the item has several in the document, those that are not the item's own conflict, and
windows that hold one are dropped; the others count. A document is contaminated by an item if consistent alignments cover
`covered` of the item's tokens, or `share` of them if that is less; plain tokens must cover `covered` or all of them, since
documents share short rows of numbers by chance.

Defined cases. Null or empty texts and items, and those without a letter or digit: no tokens, no hits. Repeated rows and items are
one document (by id and text) and one item (by id; rows of one id with different texts are further forms of it, and the best
form counts). Null ids are values like others. Empty tables: no rows. Columns other than the
named ones are not read; in remove() they pass through. Very long texts: the work is linear in the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, read

WINDOW = 8
LEAST = 5
COVERED = 13
SHARE = 0.5
BROADCAST_ROWS = 1_000_000

#: Units of measure, in the singular and plural.
UNITS = (
    "km|cm|mm|kg|mg|ml|lb|lbs|oz|ft|mi|mph|kph|hz|khz|mhz|ghz|kb|mb|gb|tb|kw|kwh|usd|eur|gbp|"
    "m|g|l|s|h|min|sec|hr|hrs|meters?|metres?|kilometers?|kilometres?|centimeters?|centimetres?|miles?|feet|foot|inch|inches|yards?|"
    "grams?|kilograms?|pounds?|ounces?|tons?|tonnes?|liters?|litres?|gallons?|cups?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|"
    "dollars?|cents?|euros?|percent|degrees?"
)
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{Ll}[\p{L}'’-]*"
_NUMBER = r"[$€£]?\p{Nd}+(?:[.,:/]\p{Nd}+)*%?"
_UNIT = rf"\x01 {{1,2}}((?i:{UNITS}))(?!\p{{L}})"
_TOKEN = r"\x01[^\x01]*\x01|\x02[^\x02]*\x02|\x03[^\x03]*\x03|[\p{L}\p{N}]+"


def _marked(text: Column, number: str, unit: str, name: str) -> Column:
    clean = F.regexp_replace(text, r"[\x01-\x03]", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, _NAME, name), _NUMBER, number), _UNIT, unit)


def template(text: Column) -> Column:
    """The template tokens: placeholders are the characters 1 (number), 2 (unit) and 3 (name)."""
    marked = _marked(text, " \x01 ", "\x01 \x02 ", " \x03 ")
    return F.array_remove(F.split(F.lower(marked), r"[^\p{L}\p{N}\x01-\x03]+"), "")


def slots(text: Column) -> Column:
    """As many tokens as template(): placeholders hold their values between two marks."""
    marked = _marked(text, " \x01$0\x01 ", "\x01 \x02$1\x02 ", " \x03$0\x03 ")
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))


def plain(text: Column) -> Column:
    """The tokens without placeholders."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, r"[\x01-\x03]", " ")), r"[^\p{L}\p{N}]+"), "")


def _windows(tokens: str, width: Column | int) -> Column:
    """(place, hash) of each window of a token column."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(
        F.size(tokens) >= w,
        F.transform(F.sequence(F.lit(0), F.size(tokens) - w), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(F.col(tokens), i + 1, w)).alias("h"))),
    )


def forms(items: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(form, item, length, t, slots, p): the template tokens, slot values and plain tokens of each form of each item. What is hashed
    to name a form is its id and text."""
    text = items[text_col]
    src = items.select(items[id_col].alias("item"), text.alias("text")).filter("text is not null")
    after = F.concat(F.lit("a "), F.col("text"))  # as it reads after another word
    first = src.select("item", F.xxhash64("item", "text", F.lit(0)).alias("form"), template(F.col("text")).alias("t"), slots(F.col("text")).alias("slots"), plain(F.col("text")).alias("p"))
    other = src.select("item", F.xxhash64("item", "text", F.lit(1)).alias("form"), F.slice(template(after), 2, 1 << 30).alias("t"), F.slice(slots(after), 2, 1 << 30).alias("slots"), F.array().cast("array<string>").alias("p"))
    other = other.join(first.select(F.col("item").alias("i"), F.col("t").alias("u")), F.col("item").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left_anti")
    both = first.unionByName(other).dropDuplicates(["form"])
    return both.filter(F.size("t") > 0).select("form", "item", F.size("t").alias("length"), "t", "slots", "p")


def index(made: DataFrame, *, window: int, least: int) -> DataFrame:
    """(form, kind, width, ipos, h) of forms: windows of kind 0 by template, of kind 1 by plain tokens (whose places are their own)."""
    width = F.least(F.lit(window), F.size("t"))
    t = made.select("form", "t", "length", width.alias("width"))
    w = t.select("form", "length", "width", F.explode(_windows("t", F.col("width"))).alias("w"), "t")
    w = w.withColumn("own", F.size(F.filter(F.slice("t", F.col("w.at") + 1, F.col("width")), lambda x: ~x.isin("\x01", "\x02", "\x03"))))
    fit = (F.col("length") >= least) & (F.col("own") * 2 >= F.col("width"))
    by_template = w.filter(fit).select("form", F.lit(0).alias("kind"), "width", F.col("w.at").alias("ipos"), F.col("w.h").alias("h"))
    # Forms with a window that does not fit: all windows of their plain tokens.
    dense = made.join(w.filter(~fit).select("form").distinct(), "form", "left_semi").filter(F.size("p") > 0)
    x = dense.select("form", "p", F.least(F.lit(window), F.size("p")).alias("width"))
    by_value = x.select("form", F.lit(1).alias("kind"), "width", F.explode(_windows("p", F.col("width"))).alias("w")).select("form", "kind", "width", F.col("w.at").alias("ipos"), F.col("w.h").alias("h"))
    return by_template.unionByName(by_value)


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least: int = LEAST, covered: int = COVERED, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc, th, item, n_covered, n_item_tokens, n_slots, exact): the contaminated documents (th: xxhash64 of the text)."""
    made = materialize(forms(items, id_col=item_col, text_col=item_text_col))
    ix = materialize(index(made, window=window, least=least))
    rows = ix.count()
    light = F.broadcast(ix) if rows <= broadcast_rows else ix
    weight = made.agg(F.sum(F.octet_length(F.array_join("slots", "")) + 16 * F.size("slots"))).first()[0] or 0
    held = made.select("form", "item", "length", "slots", F.size("p").alias("n_plain"))
    held = F.broadcast(held) if weight <= 64 * broadcast_rows else held
    widths = ix.select("kind", "width").distinct().collect()  # 2 * window numbers at most
    src = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))

    def probes(kind: int) -> DataFrame | None:
        own = [r["width"] for r in widths if r["kind"] == kind]
        if not own:
            return None
        tokens = src.select("doc", "th", (plain if kind else template)(F.col("text")).alias("t"))
        at = [F.transform(F.coalesce(_windows("t", w), F.array()), lambda x: F.struct(F.lit(w).alias("w"), x["at"].alias("pos"), x["h"].alias("g"))) for w in own]  # noqa: B023
        found = tokens.select("doc", "th", F.explode(F.concat(*at)).alias("x")).select("doc", "th", "x.w", "x.pos", "x.g")
        return found.join(light.filter(F.col("kind") == kind), (F.col("g") == F.col("h")) & (F.col("w") == F.col("width")))

    sides = [x for x in map(probes, (0, 1)) if x is not None]
    if not sides:
        return src.select("doc", "th", F.lit(None).cast(items.schema[item_col].dataType).alias("item"), *[F.lit(0).cast("long").alias(c) for c in ("n_covered", "n_item_tokens", "n_slots")], F.lit(False).alias("exact")).limit(0)
    hits = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    # One row for each alignment, combined within the task: a document's hits are in one task.
    lines = materialize(hits.groupBy("doc", "th", "form", "kind", (F.col("pos") - F.col("ipos")).alias("shift"), "width").agg(F.collect_set("ipos").alias("at")))
    spread = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + F.col("width") - 1))))
    by_value = lines.filter("kind = 1").join(held, "form")
    by_value = by_value.groupBy("doc", "th", "item", "form").agg(F.size(F.array_distinct(F.flatten(F.collect_list(spread("at"))))).cast("long").alias("n_covered"), F.first("n_plain").cast("long").alias("n_item_tokens"), F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("exact"))

    # The slots of the documents that templates hit.
    lines = lines.filter("kind = 0")
    some = lines.select(F.col("doc").alias("d"), F.col("th").alias("h")).distinct()
    text = src.join(some, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).dropDuplicates(["doc", "th"]).select(F.col("doc").alias("d"), F.col("th").alias("h"), slots(F.col("text")).alias("own"))
    both = lines.join(text, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).join(held, "form")
    places = F.filter(spread("at"), lambda p: F.substring(F.get("slots", p), 1, 1).isin("\x01", "\x02", "\x03"))
    pairs = both.withColumn("p", F.transform(places, lambda p: F.struct(p.alias("at"), F.get("slots", p).alias("a"), F.get("own", p + F.col("shift")).alias("b")))).drop("slots", "own")
    odd = F.filter("p", lambda x: (x["a"] != x["b"]) & F.exists("p", lambda y: (y["a"] == x["a"]) & (y["b"] != x["b"])))
    pairs = pairs.withColumn("odd", F.transform(odd, lambda x: x["at"]))
    pairs = pairs.withColumn("at", F.filter("at", lambda p: ~F.exists("odd", lambda o: o.between(p, p + F.col("width") - 1))))
    pairs = pairs.withColumn("at", spread("at"))
    pairs = pairs.withColumn("p", F.filter("p", lambda x: F.array_contains("at", x["at"])))
    found = pairs.groupBy("doc", "th", "item", "form").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_covered"),
        F.first("length").cast("long").alias("n_item_tokens"),
        F.max(F.size("p")).cast("long").alias("n_slots"),
        F.max((F.size("odd") == 0) & F.forall("p", lambda x: x["a"] == x["b"])).alias("exact"),
    )
    found = found.filter(F.col("n_covered") >= F.least(F.lit(float(covered)), F.col("n_item_tokens") * share))
    found = found.unionByName(by_value.filter(F.col("n_covered") >= F.least(F.lit(covered), F.col("n_item_tokens"))))
    best = found.groupBy("doc", "th", "item").agg(F.max(F.struct("n_covered", "exact", "n_item_tokens", "n_slots")).alias("b"))
    return best.select("doc", "th", "item", "b.n_covered", "b.n_item_tokens", "b.n_slots", "b.exact")


def remove(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **params) -> DataFrame:
    """The rows of docs that no item contaminates, with docs' own columns. The contaminated ones' keys are broadcast up to
    `broadcast_rows` of them, which is checked; beyond that Spark shuffles."""
    d, h = fresh(docs, "quarry_doc", "quarry_th")
    found = materialize(leaks(docs, items, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **params).select(F.col("doc").alias(d), F.col("th").alias(h)).distinct())
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    return docs.join(found, docs[id_col].eqNullSafe(F.col(d)) & (F.xxhash64(docs[text_col]) == F.col(h)), "left_anti")


def query(spark, sf_dir) -> DataFrame:
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_covered", "n_item_tokens", "n_slots", "exact").distinct()
