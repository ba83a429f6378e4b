"""Line dedup: winnowing over line hashes.

A document's lines that have a word (stripped of ASCII white space) form a sequence of digests.

1. Fingerprints. Each GRAM = 2 lines in a row have a hash; of each WINDOW = 2 such hashes in a row the least one (the
   rightmost of equals) is selected, so every run of SPAN = 3 lines holds a fingerprint that depends
   on these lines alone. What weighs `words` words is a fingerprint too: a line by itself, or
   two lines none of which weighs as much. A fingerprint carries the digests of SPAN lines to either side.
2. Positions. Fingerprints that occur once go no further. Each place of the others is joined to the earliest place of the
   corpus with the same fingerprint, and to the earliest with the same line after or before it as well; a light
   fingerprint (one selected as a minimum only) is joined by the latter two alone.
3. Extension. A joined place is compared with the earlier one line by line to both sides, as far as their digests reach.
   Beyond that lies the next fingerprint of the same run, so the matches of a run together are as long as the run.
4. The lines of the later place are deleted.

So a line goes exactly if it lies in a run of three lines, or of one or two lines with `words` words, that also occurs at
an earlier place which does not overlap it: a kept run never loses lines to a later place of itself (`a a a a b` stays,
of `a a a a a a` half goes). Longer runs consist of such runs. Places are never compared pair by pair: a run in a third of all
documents costs each place one join with one earliest place.

Order of places: (doc_id, hash of the text, line), nulls first. Rows equal in doc_id and text are
one document to this order, so all of them keep the same lines.

Defined cases. Null text: stays null, no lines. Empty text: unchanged. words = None: only runs of three lines go.
Words are runs without white space. Null doc_id: ordered first, deduplicated like any other. Repeated rows: the same result
for each. Lines without a word stay and separate nothing. Extra columns pass through, whatever their names. Very long
texts: fingerprints and the removal of lines are linear in the number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_first, materialize, read, slices

GRAM = 2
WINDOW = 2
SPAN = GRAM + WINDOW - 1
#: A run of one or two lines goes from this many words on.
WORDS = 8

_BLANK = " \t\x0b\x0c\r"


def select_minima(grams: list[int], window: int) -> list[int]:
    """Places of the least value of each window of `window` values, the rightmost of equals."""
    out: list[int] = []
    for i in range(len(grams) - window + 1):
        least = min(range(i, i + window), key=lambda k: (grams[k], -k))
        if not out or out[-1] != least:
            out.append(least)
    return out


def fingerprints(digests: list[bytes], words: list[int], least: int | None) -> Iterator[tuple[int, int, bool]]:
    """(place, lines, whether it weighs enough alone) of the fingerprints of a sequence of lines."""
    n = len(digests)
    heavy = [least is not None and w >= least for w in words]
    if least is not None:
        for i in range(n):
            if heavy[i]:
                yield i, 1, True
    grams = [xxhash.xxh3_64_intdigest(b"".join(digests[i : i + GRAM])) for i in range(n - GRAM + 1)]
    light = set(select_minima(grams, WINDOW))
    for i in range(len(grams)):
        weighs = least is not None and not any(heavy[i : i + GRAM]) and sum(words[i : i + GRAM]) >= least
        if weighs or i in light:
            yield i, GRAM, weighs


def _marks(least: int | None):
    fields = ["fp", "doc", "th", "pos", "n", "keys", "ctx", "own", "at"]

    def signed(data: bytes) -> int:
        return xxhash.xxh3_64_intdigest(data) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A line is several rows' context: small slices keep few of them as Python objects.
        for b in slices(batches, 128, 1 << 20):
            rows: list[tuple] = []
            for doc, th, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                raw = [x.strip(_BLANK) for x in text.split("\n")]
                at = [i for i, x in enumerate(raw) if x]
                d = [xxhash.xxh3_128_digest(raw[i]) for i in at]
                short = [int.from_bytes(x[:8], "little", signed=True) for x in d]
                for i, n, weighs in fingerprints(d, [len(raw[k].split()) for k in at], least):
                    own = b"".join(d[i : i + n])
                    # With the fingerprint alone, with the line after it, with the line before it. What is hashed differs in its first byte.
                    keys = [
                        signed(b"=" + own) if weighs else None,
                        signed(b">" + own + d[i + n]) if i + n < len(d) else None,
                        signed(b"<" + d[i - 1] + own) if i else None,
                    ]
                    lo, hi = max(0, i - SPAN), i + n + SPAN
                    rows.append((signed(own), doc, th, i, n, keys, short[lo:hi], i - lo, at[lo:hi]))
            if rows:
                types = [pa.int64(), b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], fields)

    return run


def _alike(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")


def matches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int | None = WORDS) -> DataFrame:
    """(doc, th, start, lines, kept_doc, kept_th, kept_start): the extended matches of later places with earlier ones. start and
    kept_start count the lines that have a word; `lines` are line numbers of the text; th is xxhash64 of the text."""
    src = docs.filter(F.col(text_col).isNotNull()).select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    kind = src.schema["doc"].dataType.simpleString()
    marks = materialize(src.mapInArrow(_marks(words), f"fp long, doc {kind}, th long, pos int, n int, keys array<long>, ctx array<long>, own int, at array<int>"))
    often = materialize(marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    marks = marks.withColumnRenamed("n", "lines")
    rows = join_first(marks, often, ["fp"]).select("doc", "th", "pos", "lines", "ctx", "own", "at", F.posexplode("keys").alias("kind", "key")).filter("key is not null")
    left, right = (F.col("kind") == 2).cast("int"), F.col("lines") + (F.col("kind") == 1).cast("int")
    rows = materialize(rows.select("key", "doc", "th", "pos", left.alias("left"), right.alias("right"), "ctx", "own", "at"))
    # min() is combined within each task before the shuffle, so a hot key is a row for each task.
    place = F.struct("doc", "th", "pos", "ctx", "own")
    first = materialize(rows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    both = join_first(rows, first, ["key"])
    same = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("th") == F.col("first.th"))
    shift = F.col("pos") - F.col("first.pos")
    both = both.filter(F.when(same, shift >= F.col("left") + F.col("right")).otherwise(F.struct("doc", "th") > F.struct("first.doc", "first.th")))
    before = _alike(F.reverse(F.slice("ctx", F.lit(1), F.col("own"))), F.reverse(F.slice("first.ctx", F.lit(1), F.col("first.own"))))
    after = _alike(F.slice("ctx", F.col("own") + 1, F.size("ctx")), F.slice("first.ctx", F.col("first.own") + 1, F.size("first.ctx")))
    both = both.withColumn("before", before).withColumn("after", after)
    # Equal keys of unlike lines (a collision of hashes) end here.
    both = both.filter((F.col("before") >= F.col("left")) & (F.col("after") >= F.col("right")))
    # Within one document a match may not reach into its kept place.
    after = F.when(same, F.least(F.col("after"), shift - F.col("left"))).otherwise(F.col("after"))
    before = F.when(same, F.least(F.col("before"), shift - after)).otherwise(F.col("before"))
    lines = F.slice("at", F.col("own") - before + 1, before + after)
    return both.select("doc", "th", (F.col("pos") - before).alias("start"), lines.alias("lines"), F.col("first.doc").alias("kept_doc"), F.col("first.th").alias("kept_th"), (F.col("first.pos") - before).alias("kept_start"))


def repeated_lines(docs: DataFrame, **params) -> DataFrame:
    """(doc, th, gone): the line numbers to delete of each document that has any, in order."""
    found = matches(docs, **params).select("doc", "th", F.explode("lines").alias("line"))
    return found.groupBy("doc", "th").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int | None = WORDS, removed_col: str | None = None) -> DataFrame:
    """docs with its text without later repeated runs; removed_col: also the number of lines removed."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, words=words)
    d, h, g, x = fresh(docs, "quarry_doc", "quarry_th", "quarry_gone", "quarry_lines")
    gone = gone.select(F.col("doc").alias(d), F.col("th").alias(h), F.col("gone").alias(g))
    both = docs.join(gone, docs[id_col].eqNullSafe(F.col(d)) & (F.xxhash64(docs[text_col]) == F.col(h)), "left")
    both = both.withColumn(x, F.when(F.col(g).isNotNull(), F.split(docs[text_col], "\n", -1)))
    # The stretches between deleted lines: one slice for each, so linear.
    starts, ends = F.concat(F.array(F.lit(0)), F.transform(g, lambda i: i + 1)), F.concat(F.col(g), F.array(F.size(x)))
    kept = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["b"] > s["a"])
    text = F.when(F.col(g).isNull(), docs[text_col]).otherwise(F.array_join(F.flatten(F.transform(kept, lambda s: F.slice(x, s["a"] + 1, s["b"] - s["a"]))), "\n"))
    out = [text.alias(c) if c == text_col else docs[c] for c in docs.columns]
    return both.select(*out, *([F.coalesce(F.size(g), F.lit(0)).cast("long").alias(removed_col)] if removed_col else []))


def query(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, removed_col="n_removed")
