"""Substring dedup by hashing of units.

A text is cut into units: lines, and lines into sentences (a passage that is set into the middle
of a line would otherwise never be a unit). A unit is normalised (case folded, white space
collapsed) and digested (128 bits); digests are grouped over the corpus and the occurrence that is earliest in rank
is kept. The other occurrences are repeats; runs of adjacent repeats with `min_words` words together
are removed, and the offsets of what is removed and of what is kept, in code points of the original
text, are part of the result. With min_words = 0 every repeat goes.

The earliest occurrence is found by an aggregation that combines within tasks, so a unit in a third of all
documents does not meet in one task. Repeats are joined to it by digest; the few digests that more than a two-thousandth of all
units have are broadcast instead, and their rows stay where they are.

Rank: (id, hash of the text, place in the text), nulls first. Rows equal in id and text are one document to this rank.

Defined cases. Null and empty texts have no units and stay as they are. White space alone is no unit. Null ids rank
first. Repeated rows get the same spans. Extra columns pass through apply().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .common import fresh, join_first, materialize, read, slices, without

MIN_WORDS = 20

#: A sentence: up to stops that white space or the text's end follows, or the line's end. Possessive, so linear.
_UNIT = re.compile(r"\S[^\n.!?]*+(?:[.!?]++(?!\s|\Z)[^\n.!?]*+)*+[.!?]*+")
_LINE = re.compile(r"\S[^\n]*+")


def units(text: str, sentences: bool = True) -> Iterator[tuple[int, int, str]]:
    """(start, end, normal form) of each unit; end is after its last character that is not white space."""
    for m in (_UNIT if sentences else _LINE).finditer(text):
        s = m.group()
        normal = " ".join(s.casefold().split())
        if normal:
            yield m.start(), m.start() + len(s.rstrip()), normal


def _rows(sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(8)]
            for doc, th, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for no, (start, end, normal) in enumerate(units(text, sentences)):
                    d = xxhash.xxh3_128_intdigest(normal.encode())
                    for c, v in zip(cols, ((d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63), doc, th, no, start, end, normal.count(" ") + 1)):
                        c.append(v)
            if cols[0]:
                types = [pa.int64(), pa.int64(), b.schema.field(0).type, pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["hi", "lo", "doc", "th", "no", "start", "end", "words"])

    return run


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, start, end, n_units, n_words, kept_doc, kept_start): the runs to remove; th is xxhash64 of the text,
    kept_doc and kept_start tell where the run's first unit is kept."""
    src = docs.filter(docs[text_col].isNotNull()).select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    kind = src.schema["doc"].dataType.simpleString()
    all_units = materialize(src.mapInArrow(_rows(sentences), f"hi long, lo long, doc {kind}, th long, no int, start int, end int, words int"))
    # Counts of digests alone first: most units occur once and go no further.
    often = materialize(all_units.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    some = materialize(join_first(all_units, often, ["hi", "lo"]))
    place = F.struct("doc", "th", "no", "start")
    first = materialize(some.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.first("n").alias("n")))
    later = join_first(some.drop("n"), first, ["hi", "lo"]).filter(place > F.col("first")).dropDuplicates(["doc", "th", "no"])
    # Runs within a document: places that follow each other.
    run = F.col("no") - F.row_number().over(Window.partitionBy("doc", "th").orderBy("no"))
    runs = later.withColumn("run", run).groupBy("doc", "th", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count(F.lit(1)).alias("n_units"),
        F.sum("words").alias("n_words"),
        F.min_by("first", "no").alias("kept"),
    )
    return runs.filter(F.col("n_words") >= min_words).select("doc", "th", "start", "end", "n_units", "n_words", F.col("kept.doc").alias("kept_doc"), F.col("kept.start").alias("kept_start"))


@pandas_udf(StringType())
def _cut(texts: pd.Series, bounds: pd.Series) -> pd.Series:
    """The parts of each text between bounds start, end, start, end, ...; null where the text is null."""
    return pd.Series(["".join(t[a:b] for a, b in zip(x[::2], x[1::2])) if isinstance(t, str) else None for t, x in zip(texts, bounds)], dtype=object)


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed", kept_col: str = "kept", **params) -> DataFrame:
    """docs with the text that is kept, and the spans (start, end) of the original text removed and kept, in order."""
    found = repeats(docs, id_col=id_col, text_col=text_col, **params)
    d, h, r = fresh(docs, "quarry_doc", "quarry_th", "quarry_removed")
    spans = found.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(r)).select(F.col("doc").alias(d), F.col("th").alias(h), r)
    both = docs.join(spans, docs[id_col].eqNullSafe(F.col(d)) & (F.xxhash64(docs[text_col]) == F.col(h)), "left")
    text = docs[text_col]
    removed = F.coalesce(F.col(r), F.array().cast("array<struct<start:int,end:int>>"))
    starts = F.concat(F.array(F.lit(0)), removed["end"])
    ends = F.concat(removed["start"], F.array(F.char_length(text)))
    kept = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda x: x["end"] > x["start"])
    # Only texts that lose something go through Python, where cutting is linear; a substring for each span would read the text again and again.
    cut = _cut(F.when(F.col(r).isNotNull(), text), F.when(F.col(r).isNotNull(), F.flatten(F.transform(kept, lambda x: F.array(x["start"], x["end"])))))
    new = F.when(F.col(r).isNull(), text).otherwise(cut)
    return both.select(*[new.alias(c) if c == text_col else docs[c] for c in without(docs.columns, [removed_col, kept_col])], removed.alias(removed_col), F.when(text.isNotNull(), kept).alias(kept_col))


def query(spark, sf_dir) -> DataFrame:
    found = repeats(read(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "start", "end", "n_units", "n_words", F.col("kept_doc").alias("kept_doc_id"), "kept_start").distinct()
