"""Graph operators over nodes and edges: lookups, one hop, bounded closure, reports.

Edges are joined, never collected; the closure keeps (node, depth) frontiers as DataFrames and stops
as soon as one is empty. Every ordering ends with the node id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize
from ..schema import CROSS_KINDS, DEPENDENCY_KINDS
from ..sources.adapters import Corpus
from .limits import clamp_depth, clamp_limit

NODE_COLUMNS = ["node_id", "qualified_name", "kind", "file_path", "start_line", "alias"]


def find_node(nodes: DataFrame, project, qualified_name: str) -> DataFrame:
    """The node of that name in the project; one row or none."""
    return nodes.filter((F.col("project_id") == project) & (F.coalesce("qualified_name", "name") == qualified_name)).orderBy("node_id").limit(1)


def file_context(nodes: DataFrame, project, file_path: str) -> DataFrame:
    return nodes.filter((F.col("project_id") == project) & (F.col("file_path") == file_path)).orderBy(F.asc_nulls_last("start_line"), "node_id")


def with_sources(nodes: DataFrame, workspaces: DataFrame, sources: DataFrame) -> DataFrame:
    """nodes (workspace_id, ...) with project_id and the alias of their source; empty where the workspace has none. workspaces: (id, project_id,
    source_id); sources: (id, alias). Both are small next to nodes; Spark broadcasts them by their size."""
    ws = workspaces.select(F.col("id").alias("_w"), F.col("project_id").alias("project_id"), F.col("source_id").alias("_s"))
    own = ws.join(sources.select(F.col("id").alias("_i"), F.col("alias").alias("_alias")), F.col("_s") == F.col("_i"), "left")
    kept = [c for c in nodes.columns if c not in ("project_id", "alias")]
    return nodes.select(*kept).join(own, F.col("workspace_id") == F.col("_w")).select(*kept, "project_id", F.coalesce("_alias", F.lit("")).alias("alias"))


def hop(edges: DataFrame, ids: DataFrame, kinds, direction: str) -> DataFrame:
    """(seed, node_id, kind, weight): the edges of the ids (column node_id), out or in."""
    own, other = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    seeds = ids.select(F.col("node_id").alias("seed"))
    return edges.filter(F.col("kind").isin(list(kinds))).join(seeds, F.col(own) == F.col("seed")).select("seed", F.col(other).alias("node_id"), F.col("kind").alias("edge_kind"), "weight")


def related(corpus: Corpus, ids: DataFrame, kind: str, direction: str, limit: int | None = None) -> DataFrame:
    """For each id the `limit` heaviest neighbours by edges of one kind: callers are calls in,
    callees calls out, importers imports in."""
    n = clamp_limit(limit)
    near = hop(corpus.edges, ids, [kind], direction)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "node_id")).cast("long")).filter(F.col("rank") <= n)
    return best.join(corpus.nodes.select(*NODE_COLUMNS), "node_id").select("seed", "rank", "weight", *NODE_COLUMNS)


def reachable(corpus: Corpus, start: str, direction: str, max_depth: int | None = None, limit: int | None = None, kinds=DEPENDENCY_KINDS, stored: bool = False) -> DataFrame:
    """The nodes that `start` depends on (direction out) or that depend on it (in), with their least depth. On a cycle, start is
    among them. The edges are read once for each level: stored says that they are a stored table; else their two columns are stored
    first, unless one level is all."""
    depth = clamp_depth(max_depth)
    own, other = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    steps = corpus.edges.filter(F.col("kind").isin(list(kinds))).select(F.col(own).alias("a"), F.col(other).alias("b"))
    steps = steps if stored or depth == 1 else materialize(steps)  # not made distinct: each frontier is
    seen = front = steps.filter(F.col("a") == start).select(F.col("b").alias("node_id")).distinct().withColumn("min_depth", F.lit(1))
    for level in range(2, depth + 1):
        front = front.join(steps, F.col("node_id") == F.col("a")).select(F.col("b").alias("node_id")).distinct().join(seen.select("node_id"), "node_id", "left_anti").withColumn("min_depth", F.lit(level))
        front = materialize(front)
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    out = seen.join(corpus.nodes.select(*NODE_COLUMNS), "node_id")
    return out.orderBy("min_depth", F.asc_nulls_last("qualified_name"), "node_id").limit(clamp_limit(limit))


def cross_package(corpus: Corpus, a: str, b: str, limit: int | None = None) -> DataFrame:
    """The heaviest edges from package a to package b."""
    src = corpus.nodes.filter(F.col("package_id") == a).select(F.col("node_id").alias("source_id"), F.col("qualified_name").alias("source_name"))
    tgt = corpus.nodes.filter(F.col("package_id") == b).select(F.col("node_id").alias("target_id"), F.col("qualified_name").alias("target_name"))
    e = corpus.edges.filter(F.col("kind").isin(list(CROSS_KINDS))).join(src, "source_id").join(tgt, "target_id")
    return e.select("source_id", "target_id", "kind", "weight", "source_name", "target_name").orderBy(F.desc("weight"), "source_id", "target_id", "kind").limit(clamp_limit(limit))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node but containment; a self-loop counts twice. Counted within tasks first."""
    return edges.filter("kind <> 'contains'").select(F.explode(F.array("source_id", "target_id")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def project_nodes(corpus: Corpus, project) -> DataFrame:
    own = corpus.nodes.filter(F.col("project_id") == project)
    return own.join(degrees(corpus.edges), "node_id", "left").select("node_id", "name", F.coalesce("qualified_name", "name").alias("qualified_name"), "kind", "file_path", "alias", F.coalesce("degree", F.lit(0)).alias("degree"))


def project_edges(corpus: Corpus, project) -> DataFrame:
    own = corpus.nodes.filter(F.col("project_id") == project).select(F.col("node_id").alias("source_id"))
    return corpus.edges.filter("kind <> 'contains'").join(own, "source_id", "left_semi").select("source_id", "target_id", "kind", "weight")


def kind_counts(nodes: DataFrame, project) -> DataFrame:
    return nodes.filter(F.col("project_id") == project).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def node_detail(corpus: Corpus, project, node_id: str) -> DataFrame:
    """A node's attributes with its numbers of callers, callees and importers; no row if it is not in the project."""
    e = corpus.edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    into = F.col("target_id") == node_id
    counts = e.agg(F.count_if(into & (F.col("kind") == "calls")).alias("callers"), F.count_if((F.col("source_id") == node_id) & (F.col("kind") == "calls")).alias("callees"), F.count_if(into & (F.col("kind") == "imports")).alias("importers"))
    node = corpus.nodes.filter((F.col("project_id") == project) & (F.col("node_id") == node_id))
    return node.select("node_id", "name", "qualified_name", "kind", "file_path", "start_line", "signature", "docstring").join(F.broadcast(counts), how="cross")  # one row each


def hide_kinds(nodes: DataFrame, edges: DataFrame, kinds) -> tuple[DataFrame, DataFrame]:
    """Nodes without those kinds, and the edges whose ends both remain."""
    left = nodes.filter(~F.col("kind").isin(list(kinds)))
    ids = left.select(F.col("node_id").alias("end"))
    return left, edges.join(ids, F.col("source_id") == F.col("end"), "left_semi").join(ids, F.col("target_id") == F.col("end"), "left_semi")


def structural(corpus: Corpus, project, qualified_name: str, query_type: str = "callers", limit: int | None = None, kinds=None) -> DataFrame:
    """The structural search: a relation of a named symbol. As in the service, `kinds` filters what the limit left;
    an unknown symbol gives no rows, an unknown query type an error."""
    hops = {"callers": ("calls", "in"), "callees": ("calls", "out"), "importers": ("imports", "in")}
    deep = {"dependencies": "out", "dependents": "in"}
    if query_type == "file":
        out = file_context(corpus.nodes, project, qualified_name).limit(clamp_limit(limit)).select(*NODE_COLUMNS)
    elif query_type in hops:
        out = related(corpus, find_node(corpus.nodes, project, qualified_name), *hops[query_type], limit).select(*NODE_COLUMNS)
    elif query_type in deep:
        row = find_node(corpus.nodes, project, qualified_name).select("node_id").first()
        if row is None:
            return corpus.nodes.select(*NODE_COLUMNS).limit(0)
        out = reachable(corpus, row[0], deep[query_type], 5, limit).select(*NODE_COLUMNS)
    else:
        raise ValueError(f"unknown query type: {query_type}")
    return out.filter(F.col("kind").isin(list(kinds))) if kinds else out


def project_counts(corpus: Corpus) -> DataFrame:
    """For each project its nodes, and the edges that leave them."""
    n = corpus.nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = corpus.edges.join(corpus.nodes.select(F.col("node_id").alias("source_id"), "project_id"), "source_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "project_id", "left").select("project_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def source_packages(corpus: Corpus) -> DataFrame:
    """For each source its packages' names in order; none is an empty list."""
    names = corpus.packages.groupBy("workspace_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return corpus.workspaces.join(names, "workspace_id", "left").select("workspace_id", "alias", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def package_pairs(corpus: Corpus) -> DataFrame:
    """Which packages depend on which: the distinct pairs over calls and imports between different packages."""
    p = corpus.nodes.filter("package_id is not null").select("node_id", "package_id")
    e = corpus.edges.join(p.select(F.col("node_id").alias("source_id"), F.col("package_id").alias("source_package")), "source_id").join(p.select(F.col("node_id").alias("target_id"), F.col("package_id").alias("target_package")), "target_id")
    return e.filter("source_package <> target_package").select("source_package", "target_package").distinct()


def majority(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value for each key, the least one of a tie."""
    n = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.max_by(value, F.struct("n", F.lit(0))).alias("_"), F.max("n").alias("n")).drop("_").join(n, [by, "n"]).groupBy(by, "n").agg(F.min(value).alias(value))
