"""Search: vector top-k, keyword match and rank, and their fusion by reciprocal ranks.

Each leg keeps ids and scores alone; wide columns are joined to the few rows that survive. A leg's ranks are
taken after its limit, over at most 200 rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import embed_one
from ..functions.vectors import cosine
from .limits import candidate_limit, clamp_limit

RRF_K = 60
LEG = 200
#: Cells of the approximate index, how many of them a query probes, and the vectors that place their centres.
LISTS, PROBES, SAMPLE = 100, 10, 20_000
#: Parts in which a cell is compared with many queries at once.
PARTS = 8
#: Weights of the fields of a node's searchable text: name and qualified name, signature, docstring.
FIELD_WEIGHTS = {"name": 1.0, "qualified_name": 1.0, "signature": 0.4, "docstring": 0.2}


def scoped(nodes: DataFrame, project=None, kinds=None) -> DataFrame:
    out = nodes if project is None else nodes.filter(F.col("project_id") == project)
    return out.filter(F.col("kind").isin(list(kinds))) if kinds else out


def vector_leg(nodes: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """(node_id, similarity) of the `limit` nearest nodes that have a vector: a heap in each task, no full sort."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return nodes.filter(F.col("embedding").isNotNull()).select("node_id", cosine(F.col("embedding"), query).alias("similarity")).orderBy(F.desc("similarity"), "node_id").limit(limit)


def semantic_topk(nodes: DataFrame, vector: list[float], *, project=None, kinds=None, limit: int | None = None) -> DataFrame:
    """The nearest nodes, with all their columns but the vector and `similarity`."""
    own = scoped(nodes, project, kinds)
    top = vector_leg(own, vector, clamp_limit(limit))
    return own.drop("embedding").join(F.broadcast(top), "node_id")  # 100 rows at most


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def lexemes(query: str) -> list[str]:
    import re

    return sorted(set(re.findall("[a-z0-9]+", query.lower())))


def keyword_leg(nodes: DataFrame, query: str, limit: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(node_id, rank): nodes with every word of the query in some field. A word counts with the weight of its best field;
    the rank is the mean over the words. A query without words matches nothing."""
    weights = {f: w for f, w in (weights or FIELD_WEIGHTS).items() if f in nodes.columns}
    words = lexemes(query)
    if not words:
        return nodes.select("node_id", F.lit(0.0).alias("rank")).limit(0)
    held = nodes.select("node_id", *[tokens(F.col(f)).alias(f) for f in weights])

    def best(word: str) -> Column:
        parts = [F.when(F.array_contains(f, word), F.lit(w)).otherwise(F.lit(0.0)) for f, w in weights.items()]
        return F.greatest(*parts) if len(parts) > 1 else parts[0]

    scored = held.select("node_id", *[best(w).alias(f"w{i}") for i, w in enumerate(words)])
    cols = [F.col(f"w{i}") for i in range(len(words))]
    match = cols[0] > 0
    total = cols[0]
    for c in cols[1:]:
        match, total = match & (c > 0), total + c
    out = scored.filter(match).select("node_id", (total / len(words)).alias("rank"))
    return out if limit is None else out.orderBy(F.desc("rank"), "node_id").limit(limit)


def rrf(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """(node_id, score, similarity, rank): ranked legs fused; what a leg lacks adds nothing. A leg's first LEG rows count, so its
    ranks are numbered in one task whatever it holds."""
    vector, keyword = vector.orderBy(F.desc("similarity"), "node_id").limit(LEG), keyword.orderBy(F.desc("rank"), "node_id").limit(LEG)
    v = vector.withColumn("rv", F.row_number().over(Window.orderBy(F.desc("similarity"), "node_id")))
    t = keyword.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("rank"), "node_id")))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)).cast("double"), F.lit(0.0))
    return v.join(t, "node_id", "full_outer").select("node_id", (part("rv") + part("rk")).alias("score"), "similarity", "rank")


def hybrid_topk(nodes: DataFrame, vector: list[float], query: str, *, project=None, kinds=None, limit: int | None = None, keywords=None) -> DataFrame:
    """The best nodes by both legs. keywords: another keyword leg, such as fulltext.leg() over stored postings."""
    n = clamp_limit(limit)
    own = scoped(nodes, project, kinds)
    fused = rrf(vector_leg(own, vector, candidate_limit(n)), (keywords or keyword_leg)(own, query, candidate_limit(n)))
    top = fused.orderBy(F.desc("score"), "node_id").limit(n)
    return own.drop("embedding").join(F.broadcast(top), "node_id")  # 100 rows at most


def semantic_search(nodes: DataFrame, provider, text: str, **params) -> DataFrame:
    """semantic_topk() of a text that the provider embeds."""
    return semantic_topk(nodes, embed_one(provider, text), **params)


def hybrid_search(nodes: DataFrame, provider, text: str, **params) -> DataFrame:
    """hybrid_topk() of a text that the provider embeds."""
    return hybrid_topk(nodes, embed_one(provider, text), text, **params)


# An approximate index: the vectors by their nearest centre.


def fit_centres(nodes: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """lists x dimensions: unit centres by k-means on the vectors of `sample` nodes at most (those with the least hash of their id);
    every vector is indexed, the sample only places the centres. Fewer vectors than lists: each is a centre."""
    rows = nodes.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("node_id"), "node_id").limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], float)
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x.reshape(0, 1)
    if not len(x):
        return x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for k in range(len(centres)):
            own = x[near == k].sum(0)
            if (size := np.linalg.norm(own)) > 0:
                centres[k] = own / size
    return centres


def cells(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """nodes that have a vector, with `cell`, the number of the nearest centre (the first of equals). One matrix product a batch."""
    centres = np.asarray(centres, float)
    src = nodes.filter(F.col("embedding").isNotNull())
    at = src.columns.index("embedding")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column(at).to_pylist(), float)
            cell = (x @ centres.T).argmax(1) if b.num_rows and len(centres) else np.zeros(b.num_rows, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("cell", T.IntegerType())]))


def store_cells(celled: DataFrame, path: str, seed_parts: int = 8) -> None:
    """Parquet with a directory for each cell; a cell's rows are dealt over several tasks, since one may hold many."""
    celled.repartition("cell", F.pmod(F.xxhash64("node_id"), F.lit(seed_parts))).write.mode("overwrite").partitionBy("cell").parquet(path)


def probed(centres: np.ndarray, vector: list[float], probes: int = PROBES) -> list[int]:
    """The cells of the centres nearest to a vector, nearest first."""
    return np.argsort(-(np.asarray(centres, float) @ np.asarray(vector, float)), kind="stable")[:probes].tolist() if len(centres) else []


def approximate_topk(celled: DataFrame, centres: np.ndarray, vector: list[float], *, probes: int = PROBES, limit: int | None = None) -> DataFrame:
    """vector_leg() over the probed cells alone: over a stored table the filter on the partition column skips the others."""
    return vector_leg(celled.filter(F.col("cell").isin(probed(centres, vector, probes))), vector, clamp_limit(limit))


def approximate_topk_each(celled: DataFrame, centres: np.ndarray, queries: DataFrame, *, probes: int = PROBES, limit: int | None = None) -> DataFrame:
    """(query_id, node_id, similarity): approximate_topk() for each row of queries (query_id, vector), nulls apart. A query meets
    the rows of the cells it probes, in a task for each part of a cell, where one matrix product compares them; a task hands on
    `limit` rows for each of its queries, so the second step ranks few rows."""
    n = clamp_limit(limit)
    q = queries.filter(F.col("vector").isNotNull())
    kinds = (q.schema["query_id"].dataType.simpleString(), celled.schema["node_id"].dataType.simpleString())

    def near(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(i, v, c) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in probed(centres, v, probes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((b.schema.field(0).type, b.schema.field(1).type, pa.int32()))], ["query_id", "vector", "cell"])

    asked = q.select("query_id", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(near, f"query_id {kinds[0]}, vector array<float>, cell int")

    def best(key, left, right):
        import pandas as pd

        plain = lambda values: pd.Series(values, dtype=object)  # noqa: E731 - pandas' own string type comes in chunks, which Spark refuses
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": plain([]), "node_id": plain([]), "similarity": pd.Series([], dtype=float)})
        x, v = np.stack(left["embedding"]).astype(float), np.stack(right["vector"]).astype(float)
        size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(v, axis=1)
        s = np.divide(x @ v.T, size, out=np.zeros(size.shape), where=size > 0)
        ids = left["node_id"].to_numpy()
        order = np.argsort(ids, kind="stable")  # of equal similarities the least id
        rows = [order[np.argsort(-s[order, k], kind="stable")[:n]] for k in range(len(v))]
        return pd.DataFrame({"query_id": plain(np.repeat(right["query_id"].to_numpy(), [len(r) for r in rows]).tolist()), "node_id": plain(ids[np.concatenate(rows)].tolist()), "similarity": np.concatenate([s[r, k] for k, r in enumerate(rows)])})

    # A cell is compared in parts of bounded size, each with every query that probes it.
    part = F.pmod(F.xxhash64("node_id"), F.lit(PARTS)).cast("int")
    rows = celled.filter(F.col("embedding").isNotNull()).select("node_id", "embedding", "cell", part.alias("part"))
    spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    scored = rows.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInPandas(best, f"query_id {kinds[0]}, node_id {kinds[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")
