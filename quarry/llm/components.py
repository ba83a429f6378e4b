"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node's larger neighbours are tied to the least of it and its neighbours;
    small: its smaller neighbours and it itself. A node's least neighbour is combined
    within tasks, so the centre of a large star is one row a task."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v; integers): root is the least node of its component.
    Rounds end when the edge set no longer changes: the edges are then stars around the roots.
    Nulls and self-loops are not edges; no edges, no rows."""
    now = materialize(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        now = materialize(_star(_star(now, True), False))
        state, before = _state(now), state
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
