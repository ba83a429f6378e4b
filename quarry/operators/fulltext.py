"""Full text over stored postings: each node's words are cut, stemmed and weighed once, and a query reads only the buckets of its own words."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import stem
from .search import FIELD_WEIGHTS, lexemes, tokens

BUCKETS = 64

# English words that are not searched for.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]


@pandas_udf(StringType())
def _stemmed(words: pd.Series) -> pd.Series:
    known = functools.lru_cache(200_000)(stem)
    return words.map(known)


def terms(text: str, stemmed: bool = True) -> list[str]:
    """A query's distinct lexemes, without stop words."""
    if not stemmed:
        return lexemes(text)
    return sorted({stem(w) for w in lexemes(text) if w not in STOP_WORDS})


def _weighed(weight: float):
    return lambda word: F.struct(word.alias("word"), F.lit(weight).alias("weight"))


def postings(nodes: DataFrame, weights: dict[str, float] | None = None, stemmed: bool = True) -> DataFrame:
    """(bucket, lexeme, node_id, weight): each node's lexemes with the weight of the best field that has them. Rows of nodes of the same
    id are not merged here; match() does that."""
    weights = {f: w for f, w in (weights or FIELD_WEIGHTS).items() if f in nodes.columns}
    held = nodes.select("node_id", *[tokens(F.col(f)).alias(f) for f in weights])
    # A word counts once within its row, in the best field, so nothing has to be shuffled for that.
    each, seen = [], F.array().cast("array<string>")
    for w in sorted(set(weights.values()), reverse=True):
        own = F.concat(*[F.col(f) for f in weights if weights[f] == w])
        each.append(F.transform(F.array_except(own, seen), _weighed(float(w))))
        seen = F.concat(seen, own)
    words = held.select("node_id", F.explode(F.concat(*each)).alias("x")).select("node_id", F.col("x.word").alias("lexeme"), "x.weight")
    if stemmed:  # words of one stem meet
        words = words.filter(~F.col("lexeme").isin(STOP_WORDS)).withColumn("lexeme", _stemmed("lexeme")).groupBy("node_id", "lexeme").agg(F.max("weight").alias("weight"))
    return words.select(F.pmod(F.xxhash64("lexeme"), F.lit(BUCKETS)).cast("int").alias("bucket"), "lexeme", "node_id", "weight")


def store(found: DataFrame, path: str) -> None:
    """postings as Parquet: a directory for each bucket, sorted by lexeme, so that a query's filter skips row groups. Rows are dealt by
    lexeme and node, since one word may be in every node; a share over the session's advisory size is split further, so that what a
    task sorts does not grow with the nodes that have a word."""
    dealt = found.withColumn("part", F.pmod(F.xxhash64("node_id"), F.lit(8))).hint("rebalance", "bucket", "part").drop("part")
    dealt.sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lexeme string, node_id string, weight double, bucket int").parquet(path)


def match(found: DataFrame, text: str, *, stemmed: bool = True, limit: int | None = None) -> DataFrame:
    """(node_id, rank): the nodes with every lexeme of the query; the rank is the mean of their weights. A query of stop words
    alone matches nothing. The bucket is filtered by constants, so only these directories are read."""
    words = terms(text, stemmed)
    if not words:
        return found.select("node_id", F.lit(0.0).alias("rank")).limit(0)
    buckets = [F.pmod(F.xxhash64(F.lit(w)), F.lit(BUCKETS)).cast("int") for w in words]
    some = found.filter(F.col("bucket").isin(buckets) & F.col("lexeme").isin(words)).select("node_id", "lexeme", "weight")
    # Dealt by node once, for both steps.
    once = some.repartition("node_id").groupBy("node_id", "lexeme").agg(F.max("weight").alias("weight"))
    out = once.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("s")).filter(F.col("n") == len(words)).select("node_id", (F.col("s") / len(words)).alias("rank"))
    return out if limit is None else out.orderBy(F.desc("rank"), "node_id").limit(limit)


def leg(found: DataFrame, stemmed: bool = True) -> Callable[[DataFrame, str, int], DataFrame]:
    """A keyword leg over postings for search.hybrid_topk(): matches among the given nodes."""

    def run(nodes: DataFrame, text: str, limit: int) -> DataFrame:
        return match(found, text, stemmed=stemmed).join(nodes.select("node_id"), "node_id", "left_semi").orderBy(F.desc("rank"), "node_id").limit(limit)

    return run
