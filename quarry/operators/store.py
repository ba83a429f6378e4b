"""Set-based storage: dedup, upsert, deletion of stale rows, snapshots. Inputs and results are DataFrames; a sink
writes the result to a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STRONG_KINDS

EDGE_KEY = ["source_id", "target_id", "kind"]


def edge_weight(kind: Column) -> Column:
    return F.when(kind.isin(*STRONG_KINDS), 1.0).otherwise(0.5)


def dedup_max(edges: DataFrame, order: str = "ordinal") -> DataFrame:
    """One edge for each key: the heaviest, the first of equals. An aggregation, combined within tasks."""
    rest = [c for c in edges.columns if c not in EDGE_KEY]
    best = F.max_by(F.struct(*rest), F.struct("weight", -F.col(order))).alias("best")
    return edges.groupBy(*EDGE_KEY).agg(best).select(*EDGE_KEY, *[F.col(f"best.{c}").alias(c) for c in rest])


def dedup_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by `order`; of equals the one whose other columns are least."""
    rest = [order, *[c for c in rows.columns if c not in key and c != order]]
    first = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("first"))
    return first.select(*[c if c in key else F.col(f"first.{c}").alias(c) for c in rows.columns])


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], replace: list[str] | None = None) -> DataFrame:
    """current with incoming's rows: those with a new key are added, of the others the columns `replace` (all but
    the key by default) are replaced. incoming has one row for a key."""
    replace = [c for c in current.columns if c not in key] if replace is None else replace
    a, b = current.alias("a"), incoming.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    new = F.col(f"b.{key[0]}").isNotNull()
    old = F.col(f"a.{key[0]}").isNotNull()
    cols = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in key else F.when(new & (~old if c not in replace else F.lit(True)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in current.columns]
    return a.join(b, on, "full_outer").select(*cols)


def prune_stale(rows: DataFrame, live: DataFrame, path: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """rows of files that are live, and the others. No live files: all rows are stale."""
    files = live.select(path).distinct()
    return rows.join(files, path, "left_semi").select(*rows.columns), rows.join(files, path, "left_anti").select(*rows.columns)


def cascade(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends both exist."""
    ids = nodes.select(F.col("node_id").alias("end")).distinct()
    return edges.join(ids, F.col("source_id") == F.col("end"), "left_semi").join(ids, F.col("target_id") == F.col("end"), "left_semi")


def replace_edges(edges: DataFrame, changed: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges that leave nodes of `changed` are replaced by incoming's."""
    return edges.join(changed.select(F.col("node_id").alias("source_id")).distinct(), "source_id", "left_anti").select(*edges.columns).unionByName(incoming.select(*edges.columns))


def replace_refs(refs: DataFrame, workspace, incoming: DataFrame) -> DataFrame:
    """A workspace's unresolved references replaced, also by none."""
    return refs.filter(F.col("workspace_id") != workspace).unionByName(incoming.select(*refs.columns))


def unset_missing(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """rows with `column` null where it names no parent."""
    p = parents.select(F.col(parent_key).alias("_p")).distinct()
    return rows.join(p, F.col(column) == F.col("_p"), "left").select(*[F.col("_p").alias(c) if c == column else rows[c] for c in rows.columns])


def diff_snapshots(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(key, change): added, modified or deleted rows of (key, digest)."""
    a, b = old.select(F.col(key).alias("k"), F.col(digest).alias("d")).alias("a"), new.select(F.col(key).alias("k"), F.col(digest).alias("d")).alias("b")
    change = F.when(F.col("a.k").isNull(), "added").when(F.col("b.k").isNull(), "deleted").when(~F.col("a.d").eqNullSafe(F.col("b.d")), "modified")
    return a.join(b, F.col("a.k") == F.col("b.k"), "full_outer").select(F.coalesce("a.k", "b.k").alias(key), change.alias("change")).filter("change is not null")


def over_threshold(changes: DataFrame, most: int, full: bool = False) -> bool:
    """Whether there are too many changes for an automatic run; 0 is no bound, a full run has none."""
    return bool(most) and not full and changes.limit(most + 1).count() > most


def reuse(incoming: DataFrame, stored: DataFrame, key: list[str], digest: str = "body_hash", value: str = "embedding") -> DataFrame:
    """incoming with the stored value where key and digest are equal and there is one, else null."""
    s = stored.filter(F.col(value).isNotNull()).select(*key, digest, value)
    return incoming.join(s, [*key, digest], "left").select(*incoming.columns, value)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`, nulls first; of equals the one whose other columns are greatest. Combined within tasks."""
    rest = [order, *[c for c in rows.columns if c not in key and c != order]]
    last = rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("last"))
    return last.select(*[c if c in key else F.col(f"last.{c}").alias(c) for c in rows.columns])
