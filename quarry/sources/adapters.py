"""The graph model laid over the commerce and document tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Corpus:
    """nodes carry their scope (project_id, alias): a node's workspace has one project and one source."""

    nodes: DataFrame
    edges: DataFrame
    workspaces: DataFrame
    packages: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Each table of the commerce graph, in SQL that Spark and DuckDB both read.
WORKSPACES = "SELECT n_nationkey AS workspace_id, n_regionkey AS project_id, n_name AS alias FROM nation"
PACKAGES = "SELECT DISTINCT concat(c_nationkey, '/', c_mktsegment) AS package_id, c_nationkey AS workspace_id, c_mktsegment AS name FROM customer"
_NODES = """
SELECT concat('c:', c_custkey) AS node_id, c_name AS name, concat(c_mktsegment, '.', c_name) AS qualified_name, 'function' AS kind,
  concat('src/', lower(c_mktsegment), '/', c_custkey % 50, '.ts') AS file_path, CAST(c_custkey % 1000 AS INT) AS start_line,
  c_nationkey AS workspace_id, concat(c_nationkey, '/', c_mktsegment) AS package_id, concat('function ', c_name) AS signature, c_mktsegment AS docstring FROM customer
UNION ALL
SELECT concat('s:', s_suppkey), s_name, s_name, 'class', concat('lib/', s_suppkey % 20, '.go'), CAST(s_suppkey % 1000 AS INT),
  s_nationkey, CAST(NULL AS STRING), concat('class ', s_name), CAST(NULL AS STRING) FROM supplier
UNION ALL
SELECT concat('p:', p_partkey), p_name, concat(p_brand, '.', p_name), 'interface', concat('pkg/', lower(replace(p_brand, '#', '')), '.ts'), CAST(p_partkey % 1000 AS INT),
  CAST(p_partkey % 25 AS INT), CAST(NULL AS STRING), concat('interface ', p_name), p_type FROM part
"""
NODES = f"SELECT n.*, w.project_id, w.alias FROM ({_NODES}) n JOIN ({WORKSPACES}) w ON n.workspace_id = w.workspace_id"
#: Before deduplication: one edge for each order line that qualifies.
RAW_EDGES = """
SELECT concat('c:', o_custkey) AS source_id, concat('s:', l_suppkey) AS target_id, 'calls' AS kind, l_quantity / 100 AS weight, l_orderkey * 10 + l_linenumber AS ordinal
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount >= 0.10
UNION ALL
SELECT concat('s:', l_suppkey), concat('p:', l_partkey), 'uses_type', l_quantity / 100, l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_tax >= 0.08
UNION ALL
SELECT concat('p:', l_partkey), concat('c:', o_custkey), 'imports', l_quantity / 100, l_orderkey * 10 + l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 48
"""
EDGES = f"SELECT source_id, target_id, kind, max(weight) AS weight FROM ({RAW_EDGES}) r GROUP BY source_id, target_id, kind"


def duck(sql: str) -> str:
    return sql.replace("AS STRING)", "AS VARCHAR)")


def ctes(*names: str) -> str:
    """A WITH clause of the graph's tables for DuckDB."""
    have = {"workspaces": WORKSPACES, "packages": PACKAGES, "nodes": NODES, "raw_edges": RAW_EDGES, "edges": EDGES}
    return ", ".join(f"{n} AS ({duck(have[n])})" for n in names)


def commerce(spark: SparkSession, sf_dir: str) -> Corpus:
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return Corpus(spark.sql(NODES), spark.sql(EDGES), spark.sql(WORKSPACES), spark.sql(PACKAGES))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    commerce(spark, sf_dir)
    return spark.sql(RAW_EDGES)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as nodes: kind is the language, alias the source, docstring the text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("lang").alias("kind"), F.col("source").alias("alias"), F.col("text").alias("docstring"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts() with vectors where there are any."""
    d, e = texts(spark, sf_dir), table(spark, sf_dir, "embeddings")
    return d.join(e, d["node_id"] == e["vec_id"], "left").select(*[d[c] for c in d.columns], e["embedding"])
