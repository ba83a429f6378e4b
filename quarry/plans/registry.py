"""The registered queries, each with SQL that an independent engine runs on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import materialize, shared_dir
from ..functions import embedding
from ..functions import text as tx
from ..operators import context, fulltext, graph, limits, resolve, search, store
from ..sources import adapters
from ..sources.adapters import commerce, ctes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

COLS = "node_id, qualified_name, kind, file_path, start_line, alias"
DEPS = "('calls', 'imports', 'uses_type')"
PROJECT = 0
SYMBOL = "c:1"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


# Lookups and one hop.


@query(f"WITH {ctes('nodes')} SELECT {COLS} FROM nodes WHERE project_id = {PROJECT} AND qualified_name = (SELECT min(qualified_name) FROM nodes WHERE project_id = {PROJECT} AND kind = 'function') ORDER BY node_id LIMIT 1")
def node_lookup(spark, d):
    c = commerce(spark, d)
    name = c.nodes.filter((F.col("project_id") == PROJECT) & (F.col("kind") == "function")).agg(F.min("qualified_name")).first()[0]
    return graph.find_node(c.nodes, PROJECT, name).select(*graph.NODE_COLUMNS)


@query(f"WITH {ctes('nodes')} SELECT {COLS} FROM nodes WHERE project_id = {PROJECT} AND file_path = 'lib/1.go'")
def file_context(spark, d):
    return graph.file_context(commerce(spark, d).nodes, PROJECT, "lib/1.go").select(*graph.NODE_COLUMNS)


def _related_sql(seeds: str, kind: str, own: str, other: str, n: int) -> str:
    return f"""WITH {ctes("nodes", "edges")}, r AS (SELECT {own} AS seed, {other} AS node_id, weight, row_number() OVER (PARTITION BY {own} ORDER BY weight DESC, {other}) AS rank
    FROM edges WHERE kind = '{kind}' AND {own} IN ({seeds})) SELECT r.seed, r.rank, r.weight, n.{COLS.replace(", ", ", n.")} FROM r JOIN nodes n ON r.node_id = n.node_id WHERE r.rank <= {n}"""


@query(_related_sql("'s:1', 's:2', 's:3'", "calls", "target_id", "source_id", 10))
def graph_callers(spark, d):
    return graph.related(commerce(spark, d), _ids(spark, "s:1", "s:2", "s:3"), "calls", "in", 10)


@query(_related_sql("'c:1', 'c:2', 'c:4', 'c:7'", "calls", "source_id", "target_id", 5))
def graph_callees(spark, d):
    return graph.related(commerce(spark, d), _ids(spark, "c:1", "c:2", "c:4", "c:7"), "calls", "out", 5)


@query(_related_sql("SELECT concat('c:', c_custkey) FROM customer WHERE c_custkey BETWEEN 1 AND 50", "imports", "target_id", "source_id", 3))
def graph_importers(spark, d):
    return graph.related(commerce(spark, d), _ids(spark, *[f"c:{i}" for i in range(1, 51)]), "imports", "in", 3)


# Bounded closures.


def _closure_sql(start: str, own: str, other: str, depth: int, limit: int) -> str:
    return f"""WITH RECURSIVE {ctes("nodes", "edges")}, steps AS (SELECT {own} AS a, {other} AS b FROM edges WHERE kind IN {DEPS}),
    walk AS (SELECT b AS node_id, 1 AS depth FROM steps WHERE a = '{start}' UNION SELECT s.b, w.depth + 1 FROM walk w JOIN steps s ON w.node_id = s.a WHERE w.depth < {depth}),
    least_depth AS (SELECT node_id, min(depth) AS min_depth FROM walk GROUP BY node_id)
    SELECT l.min_depth, n.{COLS.replace(", ", ", n.")} FROM least_depth l JOIN nodes n ON l.node_id = n.node_id ORDER BY l.min_depth, n.qualified_name NULLS LAST, n.node_id LIMIT {limit}"""


def _closure(spark, d, start, direction, depth, limit):
    return graph.reachable(commerce(spark, d), start, direction, depth, limit).select("min_depth", *graph.NODE_COLUMNS)


@query(_closure_sql("c:1", "source_id", "target_id", 1, 10))
def deps_depth1(spark, d):
    return _closure(spark, d, "c:1", "out", 1, 10)


@query(_closure_sql("c:1", "source_id", "target_id", 5, 100))
def deps_depth5(spark, d):
    return _closure(spark, d, "c:1", "out", 5, 100)


@query(_closure_sql("s:1", "target_id", "source_id", 5, 100))
def dependents_depth5(spark, d):
    return _closure(spark, d, "s:1", "in", 5, 100)


@query(_closure_sql("s:1", "source_id", "target_id", 6, 100))
def deps_on_cycle(spark, d):
    return _closure(spark, d, "s:1", "out", 6, 100)


@query(
    f"""WITH {ctes("nodes", "edges")}, top AS (SELECT source_id AS node_id FROM edges WHERE kind = 'calls' AND target_id = 's:1' ORDER BY weight DESC, source_id LIMIT 20)
    SELECT n.{COLS.replace(", ", ", n.")} FROM top JOIN nodes n ON top.node_id = n.node_id WHERE n.kind IN ('function')"""
)
def structural_post_filter(spark, d):
    c = commerce(spark, d)
    row = c.nodes.filter("node_id = 's:1'").select("project_id", "qualified_name").first()
    return graph.structural(c, row[0], row[1], "callers", 20, ["function"])


# Reports.


@query(
    f"""WITH {ctes("nodes", "edges")}, p AS (SELECT s.package_id AS a, min(t.workspace_id) AS b FROM nodes s, nodes t WHERE s.node_id = 'c:1' AND t.node_id = 's:1' GROUP BY s.package_id),
    owned AS (SELECT node_id, qualified_name, coalesce(package_id, concat(workspace_id, '/', kind)) AS package_id FROM nodes)
    SELECT e.source_id, e.target_id, e.kind, e.weight, s.qualified_name AS source_name, t.qualified_name AS target_name FROM edges e JOIN owned s ON e.source_id = s.node_id JOIN owned t ON e.target_id = t.node_id
    WHERE s.package_id LIKE '%/BUILDING' AND t.package_id = (SELECT min(package_id) FROM owned WHERE package_id LIKE '%/class') AND s.package_id = (SELECT min(package_id) FROM owned WHERE package_id LIKE '%/BUILDING')
    ORDER BY e.weight DESC, e.source_id, e.target_id, e.kind LIMIT 20"""
)
def cross_package(spark, d):
    c = commerce(spark, d)
    c.nodes = c.nodes.withColumn("package_id", F.coalesce("package_id", F.concat("workspace_id", F.lit("/"), "kind")))
    a, b = (c.nodes.filter(F.col("package_id").endswith(x)).agg(F.min("package_id")).first()[0] for x in ("/BUILDING", "/class"))
    return graph.cross_package(c, a, b, 20)


@query(
    f"""WITH {ctes("nodes", "edges")}, ends AS (SELECT source_id AS node_id FROM edges WHERE kind <> 'contains' UNION ALL SELECT target_id FROM edges WHERE kind <> 'contains'),
    g AS (SELECT node_id, count(*) AS degree FROM ends GROUP BY node_id) SELECT n.node_id, n.name, n.qualified_name, n.kind, n.file_path, n.alias, coalesce(g.degree, 0) AS degree
    FROM nodes n LEFT JOIN g ON n.node_id = g.node_id WHERE n.project_id = {PROJECT}"""
)
def degree(spark, d):
    return graph.project_nodes(commerce(spark, d), PROJECT)


@query(f"WITH {ctes('nodes', 'edges')} SELECT e.source_id, e.target_id, e.kind, e.weight FROM edges e JOIN nodes n ON e.source_id = n.node_id WHERE n.project_id = {PROJECT} AND e.kind <> 'contains'")
def project_graph_edges(spark, d):
    return graph.project_edges(commerce(spark, d), PROJECT)


@query(f"WITH {ctes('nodes')} SELECT kind, count(*) AS n FROM nodes WHERE project_id = {PROJECT} GROUP BY kind")
def kind_counts(spark, d):
    return graph.kind_counts(commerce(spark, d).nodes, PROJECT)


@query(
    f"""WITH {ctes("nodes", "edges")} SELECT node_id, name, qualified_name, kind, file_path, start_line, signature, docstring,
    (SELECT count(*) FROM edges WHERE target_id = '{SYMBOL}' AND kind = 'calls') AS callers, (SELECT count(*) FROM edges WHERE source_id = '{SYMBOL}' AND kind = 'calls') AS callees,
    (SELECT count(*) FROM edges WHERE target_id = '{SYMBOL}' AND kind = 'imports') AS importers FROM nodes WHERE node_id = '{SYMBOL}'"""
)
def node_detail(spark, d):
    c = commerce(spark, d)
    return graph.node_detail(c, c.nodes.filter(F.col("node_id") == SYMBOL).select("project_id").first()[0], SYMBOL)


@query(
    f"""WITH {ctes("nodes", "edges")}, n AS (SELECT project_id, count(*) AS n_nodes FROM nodes GROUP BY project_id),
    e AS (SELECT project_id, count(*) AS n_edges FROM edges JOIN nodes ON source_id = node_id GROUP BY project_id) SELECT n.project_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN e ON n.project_id = e.project_id"""
)
def project_counts(spark, d):
    return graph.project_counts(commerce(spark, d))


@query(f"WITH {ctes('workspaces', 'packages')} SELECT w.workspace_id, w.alias, coalesce((SELECT string_agg(p.name, ',' ORDER BY p.name) FROM packages p WHERE p.workspace_id = w.workspace_id), '') AS names FROM workspaces w")
def source_packages(spark, d):
    return graph.source_packages(commerce(spark, d)).withColumn("names", F.array_join("names", ","))


@query(f"WITH {ctes('nodes', 'edges')}, v AS (SELECT node_id FROM nodes WHERE kind NOT IN ('interface')) SELECT source_id, target_id, kind, weight FROM edges WHERE source_id IN (SELECT node_id FROM v) AND target_id IN (SELECT node_id FROM v)")
def hide_kinds(spark, d):
    c = commerce(spark, d)
    return graph.hide_kinds(c.nodes, c.edges, ["interface"])[1]


@query(
    f"""WITH {ctes("nodes", "edges")}, o AS (SELECT node_id, coalesce(package_id, concat(workspace_id, '/', kind)) AS package_id FROM nodes)
    SELECT DISTINCT s.package_id AS source_package, t.package_id AS target_package FROM edges e JOIN o s ON e.source_id = s.node_id JOIN o t ON e.target_id = t.node_id WHERE s.package_id <> t.package_id"""
)
def package_deps(spark, d):
    c = commerce(spark, d)
    c.nodes = c.nodes.withColumn("package_id", F.coalesce("package_id", F.concat("workspace_id", F.lit("/"), "kind")))
    return graph.package_pairs(c)


@query(
    f"""WITH {ctes("nodes")}, c AS (SELECT workspace_id, kind, count(*) AS n FROM nodes GROUP BY workspace_id, kind),
    r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY n DESC, kind) AS k FROM c) SELECT workspace_id, n, kind FROM r WHERE k = 1"""
)
def majority_kind(spark, d):
    return graph.majority(commerce(spark, d).nodes, "workspace_id", "kind")


# Search over documents.

_DOCS = "docs AS (SELECT d.doc_id AS node_id, d.lang AS kind, d.source AS alias, d.text AS docstring, CAST(e.embedding AS DOUBLE[]) AS embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"
_QV = "qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7)"
_SIM = "list_cosine_similarity(embedding, v)"
QUERY_TEXT = "of the"


def _vector_sql(n: int, where: str = "TRUE") -> str:
    return f"SELECT node_id, {_SIM} AS similarity FROM docs, qv WHERE embedding IS NOT NULL AND {where} ORDER BY similarity DESC, node_id LIMIT {n}"


def _words_sql(n: int | None, where: str = "TRUE") -> str:
    limit = f"ORDER BY rank DESC, node_id LIMIT {n}" if n else ""
    return f"""SELECT node_id, 0.2 AS rank FROM docs WHERE {where} AND list_contains(string_split_regex(lower(docstring), '[^a-z0-9]+'), 'of') AND list_contains(string_split_regex(lower(docstring), '[^a-z0-9]+'), 'the') {limit}"""


def _fused_sql(n: int, where: str = "TRUE") -> str:
    k = limits.candidate_limit(n)
    return f"""WITH {_DOCS}, {_QV}, v AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, node_id) AS rv FROM ({_vector_sql(k, where)})),
    t AS (SELECT *, row_number() OVER (ORDER BY rank DESC, node_id) AS rk FROM ({_words_sql(k, where)})),
    f AS (SELECT coalesce(v.node_id, t.node_id) AS node_id, coalesce(1.0::DOUBLE / (60 + rv), 0) + coalesce(1.0::DOUBLE / (60 + rk), 0) AS score FROM v FULL OUTER JOIN t ON v.node_id = t.node_id)"""


def _docs(spark, d):
    nodes = adapters.documents(spark, d)
    vector = [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 7").select("embedding").first()[0]]
    return nodes, vector


@query(f"WITH {_DOCS}, {_QV} SELECT node_id, round(similarity, 6) AS similarity FROM ({_vector_sql(10)})")
def semantic_topk(spark, d):
    nodes, v = _docs(spark, d)
    return search.semantic_topk(nodes, v).select("node_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_DOCS}, {_QV} SELECT node_id, round(similarity, 6) AS similarity FROM ({_vector_sql(20, "kind IN ('fr', 'de')")})")
def semantic_topk_kinds(spark, d):
    nodes, v = _docs(spark, d)
    return search.semantic_topk(nodes, v, kinds=["fr", "de"], limit=20).select("node_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_DOCS}, {_QV} SELECT node_id, round(similarity, 6) AS similarity FROM ({_vector_sql(100, "alias = 'src3'")})")
def semantic_topk_project(spark, d):
    nodes, v = _docs(spark, d)
    return search.semantic_topk(nodes.withColumn("project_id", F.col("alias")), v, project="src3", limit=500).select("node_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_DOCS} SELECT node_id FROM ({_words_sql(None)})")
def keyword_match(spark, d):
    return search.keyword_leg(adapters.documents(spark, d), QUERY_TEXT).select("node_id")


@query(
    f"""WITH {ctes("nodes")}, w AS (SELECT node_id, CASE WHEN list_contains(string_split_regex(lower(name), '[^a-z0-9]+'), 'small') OR list_contains(string_split_regex(lower(qualified_name), '[^a-z0-9]+'), 'small') THEN 1.0
    WHEN list_contains(string_split_regex(lower(signature), '[^a-z0-9]+'), 'small') THEN 0.4 WHEN list_contains(string_split_regex(lower(coalesce(docstring, '')), '[^a-z0-9]+'), 'small') THEN 0.2 ELSE 0 END::DOUBLE AS rank FROM nodes)
    SELECT node_id, rank FROM w WHERE rank > 0"""
)
def keyword_rank(spark, d):
    return search.keyword_leg(commerce(spark, d).nodes, "Small")


@query(f"{_fused_sql(10)} SELECT node_id, round(score, 9) AS score FROM f")
def rrf_fuse(spark, d):
    nodes, v = _docs(spark, d)
    k = limits.candidate_limit(10)
    return search.rrf(search.vector_leg(nodes, v, k), search.keyword_leg(nodes, QUERY_TEXT, k)).select("node_id", F.round("score", 9).alias("score"))


@query(f"{_fused_sql(10)} SELECT f.node_id, d.kind, d.alias, round(score, 9) AS score FROM f JOIN docs d ON f.node_id = d.node_id ORDER BY f.score DESC, f.node_id LIMIT 10")
def hybrid_topk(spark, d):
    nodes, v = _docs(spark, d)
    return search.hybrid_topk(nodes, v, QUERY_TEXT).select("node_id", "kind", "alias", F.round("score", 9).alias("score"))


@query(f"{_fused_sql(20, "kind IN ('en')")} SELECT f.node_id, d.kind, d.alias, round(score, 9) AS score FROM f JOIN docs d ON f.node_id = d.node_id ORDER BY f.score DESC, f.node_id LIMIT 20")
def hybrid_topk_kinds(spark, d):
    nodes, v = _docs(spark, d)
    return search.hybrid_topk(nodes, v, QUERY_TEXT, kinds=["en"], limit=20).select("node_id", "kind", "alias", F.round("score", 9).alias("score"))


#: How many of the 100 cells approximate_topk probes: these vectors have hardly any clusters, and with half of the cells the recall is 0.9
#: (the tests ask for that).
PROBES = 56


@query()
def approximate_topk(spark, d):
    """The 10 nearest by the probed cells, for each vector whose id is divisible by 100."""
    own = table(spark, d, "embeddings")
    nodes = own.select(F.col("vec_id").alias("node_id"), "embedding")
    centres = search.fit_centres(nodes)
    queries = own.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.approximate_topk_each(search.cells(nodes, centres), centres, queries, probes=PROBES)


@query(f"WITH {_DOCS} SELECT node_id FROM ({_words_sql(None)})")
def postings_match(spark, d):
    """keyword_match by stored postings."""
    return fulltext.match(_postings(adapters.texts(spark, d)), QUERY_TEXT, stemmed=False).select("node_id")


@query(ORACLE_SQL["keyword_rank"])
def postings_rank(spark, d):
    return fulltext.match(_postings(commerce(spark, d).nodes), "Small", stemmed=False)


def _postings(nodes: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    fulltext.store(fulltext.postings(nodes.withColumn("node_id", F.col("node_id").cast("string")), stemmed=False), path)
    kind = nodes.schema["node_id"].dataType
    return fulltext.load(spark, path).withColumn("node_id", F.col("node_id").cast(kind))


# Context assembly over the graph, from fixed hits.

_SEEDS = [(1, "c:1", 0.9, 1), (1, "s:1", 0.8, 2), (1, "c:2", 0.7, 3), (2, "s:2", 0.95, 1), (2, "c:4", 0.6, 2), (2, "p:1", 0.5, 3)]
_HITS = "hits AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, '{n}', CAST({s} AS DOUBLE), {r})" for q, n, s, r in _SEEDS) + ") AS t(query_id, node_id, similarity, seed_rank))"


def _near_sql(name: str, own: str, other: str, top: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT f, t, row_number() OVER (PARTITION BY f ORDER BY n.qualified_name NULLS LAST, t) AS pos FROM
    (SELECT DISTINCT {own} AS f, {other} AS t FROM edges WHERE kind IN {DEPS}) JOIN nodes n ON n.node_id = t) WHERE pos <= {top})"""


_EVENTS = f"""WITH {ctes("nodes", "edges")}, {_HITS}, {_near_sql("o5", "source_id", "target_id", 5)}, {_near_sql("o3", "source_id", "target_id", 3)}, {_near_sql("i3", "target_id", "source_id", 3)},
one AS (SELECT query_id, seed_rank, CAST(o5.pos * 10 AS INT) AS step, o5.t AS node_id, similarity, 0.7::DOUBLE AS weight FROM hits JOIN o5 ON node_id = o5.f),
events AS (SELECT query_id, seed_rank, 0 AS step, node_id, similarity, 1.0::DOUBLE AS weight FROM hits UNION ALL SELECT * FROM one
UNION ALL SELECT query_id, seed_rank, CAST(step + o3.pos AS INT), o3.t, similarity, 0.4::DOUBLE FROM one JOIN o3 ON node_id = o3.f
UNION ALL SELECT query_id, seed_rank, CAST(100 + i3.pos AS INT), i3.t, similarity, 0.6::DOUBLE FROM hits JOIN i3 ON node_id = i3.f)"""


def _stored(spark, d):
    """The graph as stored tables, for queries that use it several times."""
    c = commerce(spark, d)
    c.nodes, c.edges = materialize(c.nodes), materialize(c.edges)
    return c


def _events(spark, d):
    c = _stored(spark, d)
    hits = spark.createDataFrame(_SEEDS, "query_id int, node_id string, similarity double, seed_rank int")
    return c, hits, context.expand(c, hits)


@query(f"{_EVENTS} SELECT query_id, seed_rank, step, node_id, round(similarity, 6) AS similarity, round(weight, 6) AS weight FROM events")
def context_expand(spark, d):
    return _events(spark, d)[2].select("query_id", "seed_rank", "step", "node_id", F.round("similarity", 6).alias("similarity"), F.round("weight", 6).alias("weight"))


@query(
    f"""{_EVENTS}, m AS (SELECT *, min(CASE WHEN step > 0 THEN seed_rank END) OVER (PARTITION BY query_id, node_id) AS reached FROM events),
    b AS (SELECT *, similarity * weight AS score, row_number() OVER (PARTITION BY query_id, node_id ORDER BY similarity * weight DESC, seed_rank, step) AS k FROM m WHERE step > 0 OR reached IS NULL OR reached >= seed_rank)
    SELECT query_id, node_id, round(similarity, 6) AS similarity, round(weight, 6) AS weight, round(score, 6) AS score FROM b WHERE k = 1"""
)
def context_rank(spark, d):
    r = context.rank(_events(spark, d)[2])
    return r.select("query_id", "node_id", *[F.round(c, 6).alias(c) for c in ("similarity", "weight", "score")])


@query(
    f"""WITH {ctes("nodes", "edges")}, ids AS (SELECT concat('c:', i) AS node_id FROM range(1, 41) t(i) UNION ALL SELECT concat('s:', i) FROM range(1, 11) t(i)),
    b AS (SELECT target_id AS node_id, source_id AS t, CASE WHEN kind = 'calls' THEN 'called_by' ELSE 'imported_by' END AS sort, weight FROM edges WHERE kind IN ('calls', 'imports')
    UNION ALL SELECT source_id, target_id, kind, weight FROM edges WHERE kind IN ('calls', 'imports')),
    r AS (SELECT b.*, concat(n.qualified_name, ' [', n.alias, ']') AS label, row_number() OVER (PARTITION BY b.node_id, sort ORDER BY weight DESC, t) AS k FROM b JOIN nodes n ON b.t = n.node_id)
    SELECT i.node_id, coalesce(string_agg(label, '; ' ORDER BY k) FILTER (sort = 'called_by'), '') AS called_by, coalesce(string_agg(label, '; ' ORDER BY k) FILTER (sort = 'calls'), '') AS calls,
    coalesce(string_agg(label, '; ' ORDER BY k) FILTER (sort = 'imported_by'), '') AS imported_by, coalesce(string_agg(label, '; ' ORDER BY k) FILTER (sort = 'imports'), '') AS imports
    FROM ids i LEFT JOIN r ON i.node_id = r.node_id AND r.k <= 3 GROUP BY i.node_id"""
)
def context_annotations(spark, d):
    c = _stored(spark, d)
    notes = context.annotations(c, _ids(spark, *[f"c:{i}" for i in range(1, 41)], *[f"s:{i}" for i in range(1, 11)]))
    return notes.select("node_id", *[F.array_join(k, "; ").alias(k) for k in ("called_by", "calls", "imported_by", "imports")])


@query()
def context_pack(spark, d):
    c, hits, _ = _events(spark, d)
    return context.assemble(c, hits, context.explore_budget(4000, 2))


_NOTE = """(SELECT coalesce(string_agg(label, ', ' ORDER BY k), '') FROM notes WHERE notes.node_id = p.node_id AND sort = '{}' AND k <= 3)"""
_BUDGET = context.explore_budget(4000, 2)


@query(
    f"""{_EVENTS}, m AS (SELECT *, min(CASE WHEN step > 0 THEN seed_rank END) OVER (PARTITION BY query_id, node_id) AS reached FROM events),
    b AS (SELECT *, similarity * weight AS score, row_number() OVER (PARTITION BY query_id, node_id ORDER BY similarity * weight DESC, seed_rank, step) AS k FROM m WHERE step > 0 OR reached IS NULL OR reached >= seed_rank),
    p AS (SELECT b.query_id, b.node_id, b.similarity, n.qualified_name, n.file_path, n.signature, n.docstring, n.alias, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, n.qualified_name, b.node_id) AS place FROM b JOIN nodes n ON n.node_id = b.node_id WHERE k = 1),
    both_ways AS (SELECT target_id AS node_id, source_id AS t, CASE WHEN kind = 'calls' THEN 'called_by' ELSE 'imported_by' END AS sort, weight FROM edges WHERE kind IN ('calls', 'imports')
      UNION ALL SELECT source_id, target_id, kind, weight FROM edges WHERE kind IN ('calls', 'imports')),
    notes AS (SELECT e.node_id, sort, concat(n.qualified_name, ' [', n.alias, ']') AS label, row_number() OVER (PARTITION BY e.node_id, sort ORDER BY weight DESC, t) AS k FROM (SELECT * FROM both_ways WHERE node_id IN (SELECT node_id FROM p WHERE place <= 20)) e JOIN nodes n ON e.t = n.node_id),
    parts AS (SELECT p.*, {", ".join(f"CASE WHEN place <= 20 THEN {_NOTE.format(x)} ELSE '' END AS {x}" for x in ("imported_by", "imports", "called_by", "calls"))} FROM p),
    texts AS (SELECT query_id, place, node_id, concat('### ', file_path, ' — ', qualified_name, ' [source: ', alias, '] (similarity: ', printf('%.2f', similarity), ')', chr(10), 'Signature: ', signature, chr(10),
      CASE WHEN coalesce(docstring, '') <> '' THEN concat('Docstring: ', docstring, chr(10)) ELSE '' END,
      {", ".join(f"CASE WHEN {x} <> '' THEN concat('{t}: ', {x}, chr(10)) ELSE '' END" for t, x in (("Imported by", "imported_by"), ("Imports", "imports"), ("Called by", "called_by"), ("Calls", "calls")))}) AS text FROM parts),
    sums AS (SELECT *, sum(strlen(text) // 4) OVER (PARTITION BY query_id ORDER BY place) AS used FROM texts)
    SELECT query_id, place, node_id FROM sums WHERE used + {context.HEADER_TOKENS} <= {_BUDGET}"""
)
def context_packed(spark, d):
    """Which nodes the context of each query holds, and in which order."""
    c, hits, _ = _events(spark, d)
    return context.packed(c, hits, _BUDGET).select("query_id", "place", "node_id")


@query(f"{_EVENTS} SELECT query_id, node_id, seed_rank, step FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY seed_rank, step) AS k FROM events) WHERE k = 1")
def distinct_sources(spark, d):
    return context.distinct_sources(_events(spark, d)[2].select("query_id", "node_id", "seed_rank", "step"), ["seed_rank", "step"], ["query_id"])


@query()
def context_explore(spark, d):
    """From texts to contexts: search by vectors of an offline provider and words, then assembly; one text matches nothing by words."""
    c = _stored(spark, d)
    c.nodes = materialize(embedding.embed_nodes(c.nodes, embedding.Hashed(16)))
    return context.explore(c, embedding.Hashed(16), ["automobile customer", "small polished part", "zzz"], PROJECT, 8000)


@query(
    f"""WITH {ctes("workspaces", "packages", "nodes", "edges")}, names AS (SELECT workspace_id, list(name ORDER BY name) AS names FROM packages GROUP BY workspace_id),
    lines AS (SELECT w.project_id, string_agg(concat('- ', w.alias, ' (git_repo)', CASE WHEN len(names) > 5 THEN concat(' — ', len(names), ' packages: ', array_to_string(names[1:5], ', '), ', ...') WHEN len(names) = 1 THEN concat(' — 1 package: ', names[1])
      WHEN len(names) > 1 THEN concat(' — ', len(names), ' packages: ', array_to_string(names, ', ')) ELSE '' END, chr(10)), '' ORDER BY w.alias) AS lines FROM workspaces w LEFT JOIN names n ON n.workspace_id = w.workspace_id GROUP BY w.project_id),
    nn AS (SELECT project_id, count(*) AS n FROM nodes GROUP BY project_id), ne AS (SELECT n.project_id, count(*) AS n FROM edges e JOIN nodes n ON n.node_id = e.source_id GROUP BY n.project_id)
    SELECT r_regionkey::VARCHAR AS project_id, concat('## Project: ', r_name, chr(10), CASE WHEN r_regionkey % 2 = 1 THEN concat('Description: region ', r_name, chr(10)) ELSE '' END, coalesce(concat(chr(10), '### Sources', chr(10), lines), ''),
      CASE WHEN nn.n > 0 THEN concat(chr(10), '### Stats', chr(10), nn.n, ' code symbols, ', coalesce(ne.n, 0), ' relationships', chr(10)) ELSE '' END) AS text
    FROM region LEFT JOIN lines ON lines.project_id = r_regionkey LEFT JOIN nn ON nn.project_id = r_regionkey LEFT JOIN ne ON ne.project_id = r_regionkey"""
)
def project_preamble(spark, d):
    c = commerce(spark, d)
    key = F.col("r_regionkey").cast("string")
    projects = table(spark, d, "region").select(key.alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 1, F.concat(F.lit("region "), "r_name")).alias("description"))
    ws = c.workspaces.select(F.col("workspace_id").cast("string").alias("id"), F.col("project_id").cast("string").alias("project_id"), F.col("workspace_id").cast("string").alias("source_id"), "alias")
    sources = ws.select("id", "project_id", "alias", F.lit("git_repo").alias("source_type"))
    packages = c.packages.withColumn("workspace_id", F.col("workspace_id").cast("string"))
    return context.preamble(projects, sources, ws.drop("alias"), packages, c.nodes.withColumn("workspace_id", F.col("workspace_id").cast("string")), c.edges)


# Storage.


@query(f"WITH {ctes('raw_edges')}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, kind ORDER BY weight DESC, ordinal) AS k FROM raw_edges) SELECT source_id, target_id, kind, weight, ordinal FROM r WHERE k = 1")
def edge_dedup(spark, d):
    return store.dedup_max(adapters.raw_edges(spark, d))


@query(f"WITH {ctes('raw_edges')}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, kind ORDER BY ordinal, weight) AS k FROM raw_edges) SELECT source_id, target_id, kind, weight, ordinal FROM r WHERE k = 1")
def edge_first(spark, d):
    return store.dedup_first(adapters.raw_edges(spark, d), store.EDGE_KEY, "ordinal")


# Two snapshots of the parts: the older lacks every fifth, the newer every seventh and has other names for every third.
_OLD = "old AS (SELECT p_partkey AS node_id, p_name AS name, p_brand AS package, md5(p_name) AS body_hash FROM part WHERE p_partkey % 5 <> 0)"
_NEW = "new AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_type AS package, md5(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END) AS body_hash FROM part WHERE p_partkey % 7 <> 0)"


def _snapshots(spark, d):
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    old = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("package"), F.md5("p_name").alias("body_hash"))
    new = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("node_id"), name.alias("name"), F.col("p_type").alias("package"), F.md5(name).alias("body_hash"))
    return old, new


@query(
    f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.node_id, n.node_id) AS node_id, coalesce(n.name, o.name) AS name, coalesce(o.package, n.package) AS package, coalesce(n.body_hash, o.body_hash) AS body_hash FROM old o FULL OUTER JOIN new n ON o.node_id = n.node_id"""
)
def node_upsert(spark, d):
    return store.upsert(*_snapshots(spark, d), ["node_id"], ["name", "body_hash"])


@query(f"WITH {ctes('nodes')} SELECT node_id, file_path FROM nodes WHERE file_path IN (SELECT file_path FROM nodes WHERE project_id = {PROJECT})")
def stale_cleanup(spark, d):
    n = commerce(spark, d).nodes
    return store.prune_stale(n.select("node_id", "file_path"), n.filter(F.col("project_id") == PROJECT))[0]


@query(f"WITH {ctes('nodes', 'edges')}, v AS (SELECT node_id FROM nodes WHERE start_line % 4 <> 0) SELECT source_id, target_id, kind, weight FROM edges WHERE source_id IN (SELECT node_id FROM v) AND target_id IN (SELECT node_id FROM v)")
def cascade_prune(spark, d):
    c = commerce(spark, d)
    return store.cascade(c.edges, c.nodes.filter("start_line % 4 <> 0"))


@query(
    f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.node_id, n.node_id) AS node_id, CASE WHEN o.node_id IS NULL THEN 'added' WHEN n.node_id IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM old o FULL OUTER JOIN new n ON o.node_id = n.node_id WHERE o.node_id IS NULL OR n.node_id IS NULL OR o.body_hash <> n.body_hash"""
)
def snapshot_diff(spark, d):
    old, new = _snapshots(spark, d)
    return store.diff_snapshots(old, new, "node_id", "body_hash")


@query(f"WITH {_OLD}, {_NEW} SELECT n.node_id, n.name, n.package, n.body_hash, o.package AS embedding FROM new n LEFT JOIN old o ON n.node_id = o.node_id AND n.body_hash = o.body_hash")
def hash_reuse(spark, d):
    old, new = _snapshots(spark, d)
    return store.reuse(new, old.withColumnRenamed("package", "embedding"), ["node_id"])


# Resolution and strings.

_URL = "u AS (SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', '') AS path FROM pages)"


def _paths(spark, d):
    u = table(spark, d, "pages")
    return u.select("page_id", F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^https?://", "").alias("path"))


@query(
    f"""WITH {_URL}, o AS (SELECT split_part(path, '/', 1) AS prefix, min(page_id) AS owner FROM u GROUP BY 1 UNION ALL SELECT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)), min(page_id) FROM u WHERE path LIKE '%/en/%' GROUP BY 1),
    r AS (SELECT u.page_id, u.path, o.prefix, o.owner, row_number() OVER (PARTITION BY u.page_id ORDER BY length(o.prefix) DESC, o.owner) AS k FROM u JOIN o ON u.path = o.prefix OR starts_with(u.path, concat(o.prefix, '/')))
    SELECT page_id, path, prefix, owner FROM r WHERE k = 1"""
)
def longest_prefix_project(spark, d):
    u = _paths(spark, d)
    one, two = F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))
    owners = u.groupBy(one.alias("prefix")).agg(F.min("page_id").alias("owner")).unionByName(u.filter("path like '%/en/%'").groupBy(F.concat(one, F.lit("/"), two).alias("prefix")).agg(F.min("page_id").alias("owner")))
    return resolve.longest_prefix(u, owners, "path", "prefix")


@query(
    f"""WITH {_URL}, s AS (SELECT page_id, concat('@', path) AS spec FROM u WHERE page_id % 2 = 0 UNION ALL SELECT page_id, path FROM u WHERE page_id % 2 = 1)
    SELECT page_id, regexp_extract(spec, '^(@[^/]+/[^/]+|[^/]*)', 1) AS package, regexp_extract(spec, '^(?:@[^/]+/[^/]+|[^@/][^/]*)/(.*)$', 1) AS subpath FROM s"""
)
def specifier_split(spark, d):
    s = _paths(spark, d).select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("@"), "path")).otherwise(F.col("path")).alias("spec"))
    return s.select("page_id", tx.specifier_package(F.col("spec")).alias("package"), tx.specifier_subpath(F.col("spec")).alias("subpath"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(concat(' ', p_name, ' (', p_brand, ')!'))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.slug(F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")!"))).alias("slug"))


_PLACES = "CASE p_partkey % 4 WHEN 0 THEN concat('packages/', lower(p_brand), '/src/a.ts') WHEN 1 THEN concat('x/internal/', p_size, '/b.go') WHEN 2 THEN concat('apps/', p_size, '/cmd/c.ts') ELSE concat('docs/', p_size, '.md') END"


@query(
    f"""WITH f AS (SELECT p_partkey, {_PLACES} AS path FROM part), x AS (SELECT *, regexp_extract(path, '^(.*?(?:^|/)(?:packages|apps|libs|services)/[^/]+)/', 1) AS a, regexp_extract(path, '^(.*?(?:^|/)(?:internal|cmd|pkg)/[^/]+)/', 1) AS b FROM f)
    SELECT p_partkey, path, CASE WHEN a <> '' THEN a ELSE b END AS dir FROM x"""
)
def package_dir(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(_PLACES).alias("path")).withColumn("dir", tx.package_dir(F.col("path")))


# Imports between the documents' sources: parts import a package named by brand, which another workspace owns.
_REFS = "refs AS (SELECT concat('p:', p_partkey) AS source_id, p_partkey % 25 AS workspace_id, concat('@lib/', lower(replace(p_brand, '#', '')), CASE WHEN p_partkey % 3 = 0 THEN '/util' ELSE '' END) AS raw_import FROM part)"
_PKGS = "pkgs AS (SELECT DISTINCT concat('k', lower(replace(p_brand, '#', ''))) AS package_id, p_size % 25 AS workspace_id, concat('@lib/', lower(replace(p_brand, '#', ''))) AS name, 'm' AS path FROM part WHERE p_size <= 3)"
_TARGETS = "targets AS (SELECT concat('t:', p_partkey) AS node_id, concat('k', lower(replace(p_brand, '#', ''))) AS package_id, concat('m/', CASE p_partkey % 5 WHEN 0 THEN 'src/index.ts' WHEN 1 THEN 'src/util.ts' WHEN 2 THEN 'util/index.ts' ELSE concat('z', p_partkey, '.ts') END) AS file_path, CAST(p_partkey % 100 AS INT) AS start_line FROM part)"
_ENDS = [*resolve.EXTENSIONS, *["/index" + e for e in resolve.EXTENSIONS], ".go"]
_TAILS = [*[("e", i, "m/" + f) for i, f in enumerate(resolve.ENTRY_FILES)], *[("s", i, f) for i, f in enumerate(pre + "util" + x for pre in ("", "m/", "m/src/") for x in _ENDS)]]
_LINKS = f"""{_REFS}, {_PKGS}, {_TARGETS}, tails AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {i}, '{f}')" for a, i, f in _TAILS)}) AS v(sort, pos, file_path)),
    c AS (SELECT r.source_id, r.raw_import, p.package_id, CASE WHEN r.raw_import LIKE '%/util' THEN 's' ELSE 'e' END AS sort FROM refs r JOIN pkgs p ON regexp_replace(r.raw_import, '/util$', '') = p.name AND r.workspace_id <> p.workspace_id),
    h AS (SELECT c.source_id, c.raw_import, coalesce(x.pos, 1000) AS pos, t.package_id, t.file_path, t.start_line, t.node_id FROM c JOIN targets t ON c.package_id = t.package_id LEFT JOIN tails x ON x.sort = c.sort AND x.file_path = t.file_path
      WHERE x.pos IS NOT NULL OR c.sort = 'e' OR t.file_path LIKE '%util%'),
    b AS (SELECT *, row_number() OVER (PARTITION BY source_id, raw_import ORDER BY package_id, pos, file_path, start_line, node_id) AS k FROM h),
    links AS (SELECT source_id, raw_import, node_id AS target_id FROM b WHERE k = 1)"""


def _cross(spark, d):
    part = table(spark, d, "part")
    part.createOrReplaceTempView("part")
    get = lambda cte: spark.sql(cte.partition(" AS (")[2][:-1])
    return get(_REFS), get(_PKGS), get(_TARGETS)


@query(f"WITH {_LINKS} SELECT DISTINCT source_id, target_id, 'imports' AS kind, 0.5::DOUBLE AS weight FROM links")
def cross_source_resolve(spark, d):
    return resolve.resolve_cross(*_cross(spark, d))


@query(f"WITH {_LINKS} SELECT r.source_id, r.workspace_id, r.raw_import FROM refs r WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.source_id = r.source_id AND l.raw_import = r.raw_import)")
def cross_source_open_refs(spark, d):
    refs, packages, nodes = _cross(spark, d)
    return resolve.open_refs(refs, resolve.cross_links(refs, packages, nodes))


@query(f"""WITH {_LINKS} SELECT count(l.target_id) AS resolved, count(*) - count(l.target_id) AS still_unresolved, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id FROM links)) AS edges
    FROM refs r LEFT JOIN links l ON l.source_id = r.source_id AND l.raw_import = r.raw_import""")
def cross_source_counts(spark, d):
    refs, packages, nodes = _cross(spark, d)
    return resolve.cross_counts(refs, resolve.cross_links(refs, packages, nodes))


# Paths and imports: each supplier has a file, and parts import them in relative and aliased ways.
_FILES = "files AS (SELECT concat(CASE s_suppkey % 3 WHEN 0 THEN 'a/b/' WHEN 1 THEN 'a/' ELSE 'lib/src/' END, 'f', s_suppkey % 30, CASE s_suppkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' ELSE '.js' END) AS file_path FROM supplier)"
_IMPORTS = """imports AS (SELECT p_partkey AS id, concat('a/b/x', p_partkey % 10, '.ts') AS file_path, CASE p_partkey % 6 WHEN 0 THEN concat('./f', p_size) WHEN 1 THEN concat('../f', p_size) WHEN 2 THEN concat('@lib/f', p_size)
    WHEN 3 THEN concat('.././b/../../a/./b/f', p_size) WHEN 4 THEN concat('../f', p_size, '.js') ELSE 'node:fs' END AS specifier FROM part)"""
_PROBES = [("", 0), *[(e, 1 + i) for i, e in enumerate(resolve.EXTENSIONS)], *[("/index" + e, 5 + i) for i, e in enumerate(resolve.EXTENSIONS)]]
_PROBED = f"""{_FILES}, {_IMPORTS}, w AS (SELECT id, CASE id % 6 WHEN 0 THEN concat('a/b/', specifier[3:]) WHEN 1 THEN concat('a/', specifier[4:]) WHEN 2 THEN concat('lib/src/', specifier[6:]) WHEN 3 THEN concat('a/b/', regexp_extract(specifier, '[^/]*$')) WHEN 4 THEN concat('a/', specifier[4:]) END AS path FROM imports WHERE id % 6 < 5),
    t AS (SELECT id, concat(path, e) AS file_path, pos FROM w CROSS JOIN (VALUES {", ".join(f"('{e}', {i})" for e, i in _PROBES)}) AS p(e, pos)
      UNION ALL SELECT id, regexp_replace(path, '\\.js$', e), pos FROM w CROSS JOIN (VALUES ('.ts', 20), ('.tsx', 21)) AS p(e, pos) WHERE path LIKE '%.js'),
    r AS (SELECT t.id, t.file_path AS resolved_path, row_number() OVER (PARTITION BY t.id ORDER BY pos) AS k FROM t JOIN (SELECT DISTINCT file_path FROM files) f ON f.file_path = t.file_path)"""


def _resolved(spark, d):
    files, imports = _over(spark, d, _FILES, _IMPORTS)
    aliases = spark.createDataFrame([("@lib", "lib/src")], "alias string, target string")
    return resolve.resolve_imports(imports, aliases, files)


@query(f"WITH {_PROBED} SELECT i.id, i.file_path, i.specifier, r.resolved_path FROM imports i JOIN r ON r.id = i.id AND r.k = 1")
def import_resolve(spark, d):
    return _resolved(spark, d)[0].select("id", "file_path", "specifier", "resolved_path")


@query(f"WITH {_PROBED} SELECT i.id, i.file_path, i.specifier FROM imports i WHERE i.id % 6 < 5 AND NOT EXISTS (SELECT 1 FROM r WHERE r.id = i.id)")
def import_unresolved(spark, d):
    return _resolved(spark, d)[1].select("id", "file_path", "specifier")


@query(
    """WITH paths AS (SELECT p_partkey AS id, concat('a/b', p_partkey % 3, '/', repeat('../', CAST(p_size % 4 AS INT)), './c', p_size % 5, '//d') AS path FROM part)
    SELECT id, concat(CASE p_size WHEN 0 THEN concat('a/b', id % 3, '/') WHEN 1 THEN 'a/' WHEN 2 THEN '' ELSE '../' END, regexp_extract(path, 'c[0-9]'), '/d') AS path FROM paths JOIN (SELECT p_partkey, p_size % 4 AS p_size FROM part) USING (p_partkey)""".replace("SELECT p_partkey AS id, concat", "SELECT p_partkey, p_partkey AS id, concat")
)
def normal_paths(spark, d):
    part = table(spark, d, "part")
    path = F.concat(F.lit("a/b"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.repeat(F.lit("../"), (F.col("p_size") % 4).cast("int")), F.lit("./c"), (F.col("p_size") % 5).cast("string"), F.lit("//d"))
    return part.select(F.col("p_partkey").alias("id"), tx.normal_path(path).alias("path"))


# Calls and predicates: each part calls a name that a supplier's symbol has in some file.
_SYMBOLS = "symbols AS (SELECT concat('t:', s_suppkey) AS node_id, concat('f', s_suppkey % 40) AS file_path, concat('fn', s_suppkey % 67) AS name FROM supplier)"
_CALLS = """calls AS (SELECT p_partkey AS id, concat('f', p_partkey % 50) AS file_path, CASE p_partkey % 5 WHEN 0 THEN concat('obj.fn', p_size) WHEN 1 THEN 'console.log' WHEN 2 THEN 'list.map' ELSE concat('fn', p_size + 20) END AS callee FROM part)"""
_IMPORTED = "imported AS (SELECT DISTINCT concat('f', p_partkey % 50) AS file_path, concat('f', p_size % 40) AS resolved_path FROM part WHERE p_partkey % 11 = 0)"


def _over(spark, d, *names):
    """The CTEs' rows, which Spark and DuckDB read alike."""
    for t in ("part", "supplier", "events", "orders"):
        table(spark, d, t).createOrReplaceTempView(t)
    return [spark.sql(cte.partition(" AS (")[2][:-1]) for cte in names]


@query(
    f"""WITH {_SYMBOLS}, {_CALLS}, {_IMPORTED}, own AS (SELECT *, regexp_extract(callee, '[^.]*$') AS name FROM calls WHERE callee <> 'console.log'),
    m AS (SELECT o.id, 1 AS tier, s.node_id FROM own o JOIN symbols s ON o.file_path = s.file_path AND o.name = s.name
    UNION ALL SELECT o.id, 2, s.node_id FROM own o JOIN imported i ON o.file_path = i.file_path JOIN symbols s ON s.file_path = i.resolved_path AND s.name = o.name
    UNION ALL SELECT o.id, 3, s.node_id FROM own o JOIN (SELECT name, min(node_id) AS node_id FROM symbols GROUP BY name HAVING count(*) = 1) s ON o.name = s.name WHERE o.callee <> 'list.map'),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, node_id) AS k FROM m) SELECT id, node_id AS target_id, tier FROM r WHERE k = 1"""
)
def call_resolve(spark, d):
    symbols, calls, imported = _over(spark, d, _SYMBOLS, _CALLS, _IMPORTED)
    return resolve.resolve_calls(calls, symbols, imported)


_SPECIFIERS = """specifiers AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'node:fs' WHEN 1 THEN 'path/posix' WHEN 2 THEN concat('github.com/x/', p_size) WHEN 3 THEN 'net/http' WHEN 4 THEN 'console.log' ELSE CASE WHEN p_size % 2 = 0 THEN 'obj.map' ELSE 'obj.mapped' END END AS s FROM part)"""


@query(
    f"""WITH {_SPECIFIERS} SELECT id, split_part(regexp_replace(s, '^node:', ''), '/', 1) IN ('fs', 'path', 'net') AS node_builtin, NOT contains(split_part(s, '/', 1), '.') AS go_stdlib,
    s = 'console.log' AS global_call, s = 'obj.map' AS method FROM specifiers"""
)
def builtin_predicates(spark, d):
    (s,) = _over(spark, d, _SPECIFIERS)
    c = F.col("s")
    return s.select("id", resolve.is_node_builtin(c).alias("node_builtin"), resolve.is_go_stdlib(c).alias("go_stdlib"), resolve.is_global_call(c).alias("global_call"), resolve.is_builtin_method_call(c).alias("method"))


_TYPE_REFS = "type_refs AS (SELECT concat('o', o_custkey % 97) AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 'string' ELSE concat('T', o_custkey % 13) END AS type, CAST(o_orderkey % 1000 AS INT) AS line_number FROM orders)"


@query(f"WITH {_TYPE_REFS} SELECT source_id, type, min(line_number) AS line_number FROM type_refs WHERE type <> 'string' GROUP BY source_id, type")
def type_refs_distinct(spark, d):
    return resolve.distinct_types(*_over(spark, d, _TYPE_REFS))


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k = 1")
def latest_job(spark, d):
    return store.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query(
    f"""WITH {ctes("edges")}, fresh AS (SELECT source_id, target_id, kind, 1.0::DOUBLE AS weight FROM edges WHERE source_id IN ('c:1', 'c:2') AND weight > 0.2)
    SELECT source_id, target_id, kind, weight FROM edges WHERE source_id NOT IN ('c:1', 'c:2', 's:3') UNION ALL SELECT * FROM fresh"""
)
def edge_replace(spark, d):
    e = commerce(spark, d).edges
    fresh = e.filter(F.col("source_id").isin("c:1", "c:2") & (F.col("weight") > 0.2)).withColumn("weight", F.lit(1.0))
    return store.replace_edges(e, _ids(spark, "c:1", "c:2", "s:3"), fresh)


@query(f"WITH {_PKGS}, o AS (SELECT p_partkey AS node_id, concat('k', lower(replace(p_brand, '#', ''))) AS package_id FROM part) SELECT o.node_id, p.package_id FROM o LEFT JOIN (SELECT DISTINCT package_id FROM pkgs WHERE workspace_id < 3) p ON o.package_id = p.package_id")
def package_unset(spark, d):
    owned, packages = _over(spark, d, "o AS (SELECT p_partkey AS node_id, concat('k', lower(replace(p_brand, '#', ''))) AS package_id FROM part)", _PKGS)
    return store.unset_missing(owned, "package_id", packages.filter("workspace_id < 3"), "package_id")


@query(f"WITH {ctes('nodes')}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS LAST, node_id) AS k FROM nodes) SELECT file_path, node_id, start_line FROM r WHERE k = 1")
def file_heads(spark, d):
    return resolve.first_nodes(commerce(spark, d).nodes).select("file_path", "node_id", "start_line")


@query(
    f"""WITH {ctes("nodes")}, n AS (SELECT node_id, qualified_name, file_path, start_line FROM nodes WHERE kind <> 'function'),
    refs AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, '.', p_name) WHEN 1 THEN concat('lib/', p_partkey % 30, '.go') ELSE 'nothing' END AS source FROM part)
    SELECT r.id, r.source, coalesce((SELECT min(node_id) FROM n WHERE n.qualified_name = r.source), (SELECT node_id FROM n WHERE n.file_path = r.source ORDER BY start_line NULLS LAST, node_id LIMIT 1)) AS node_id FROM refs r"""
)
def two_tier_ids(spark, d):
    nodes = commerce(spark, d).nodes.filter("kind <> 'function'")
    (refs,) = _over(spark, d, "refs AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, '.', p_name) WHEN 1 THEN concat('lib/', p_partkey % 30, '.go') ELSE 'nothing' END AS source FROM part)")
    return resolve.node_ids(refs, nodes)


@query(f"WITH {ctes('nodes')} SELECT n.node_id, r.n_regionkey AS project_id, CASE WHEN r.n_nationkey % 4 = 0 THEN '' ELSE r.n_name END AS alias FROM nodes n JOIN nation r ON r.n_nationkey = n.workspace_id")
def nodes_with_sources(spark, d):
    """Workspaces divisible by 4 have no source."""
    nation = table(spark, d, "nation")
    ws = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("project_id"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).alias("source_id"))
    sources = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("alias"))
    return graph.with_sources(commerce(spark, d).nodes, ws, sources).select("node_id", "project_id", "alias")


@query(
    """SELECT p_partkey AS id, concat(CASE WHEN p_size % 3 = 0 THEN 'w1' ELSE concat('k', p_size) END, '/src/', p_brand, '.ts::', p_name) AS node_id, concat_ws(chr(10), CASE WHEN p_size % 2 = 0 THEN p_name END, p_type) AS input,
    sha256(p_name) AS body_hash, CAST((strlen(p_name) // 4) AS BIGINT) AS n_tokens, concat('pkg/', p_brand) AS root, p_type AS symbol FROM part"""
)
def text_functions(spark, d):
    part = table(spark, d, "part")
    none = F.lit(None).cast("string")
    package = F.when(F.col("p_size") % 6 == 0, "").when(F.col("p_size") % 3 == 0, none).otherwise(F.concat(F.lit("k"), F.col("p_size").cast("string")))
    entry = F.concat(F.lit("pkg/"), "p_brand", F.when(F.col("p_size") % 2 == 0, "/src/index.ts").otherwise("/dist"))
    return part.select(
        F.col("p_partkey").alias("id"),
        tx.node_id(package, F.lit("w1"), F.concat(F.lit("src/"), "p_brand", F.lit(".ts")), F.col("p_name")).alias("node_id"),
        tx.join_parts(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), none, F.col("p_type")).alias("input"),
        tx.body_hash(F.col("p_name")).alias("body_hash"),
        tx.fallback_tokens(F.col("p_name")).alias("n_tokens"),
        tx.entry_root(entry).alias("root"),
        tx.clean_symbol(F.concat(F.when(F.col("p_size") % 2 == 0, "* as ").otherwise(""), "p_type")).alias("symbol"),
    )


@query(
    """WITH r AS (SELECT concat('p:', p_partkey) AS source_id, p_partkey % 5 AS workspace_id, p_brand AS raw_import FROM part)
    SELECT * FROM r WHERE workspace_id <> 2 UNION ALL SELECT concat('s:', s_suppkey), 2, 'left-pad' FROM supplier"""
)
def ref_replace(spark, d):
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    refs = part.select(F.concat(F.lit("p:"), "p_partkey").alias("source_id"), (F.col("p_partkey") % 5).alias("workspace_id"), F.col("p_brand").alias("raw_import"))
    new = supplier.select(F.concat(F.lit("s:"), "s_suppkey").alias("source_id"), F.lit(2).cast("long").alias("workspace_id"), F.lit("left-pad").alias("raw_import"))
    return store.replace_refs(refs, 2, new)


@query("SELECT kind, count(*) AS n, sum(CASE WHEN kind IN ('contains', 'extends', 'implements', 'embeds') THEN 1.0 ELSE 0.5 END)::DOUBLE AS weight FROM (SELECT CASE p_size % 6 WHEN 0 THEN 'contains' WHEN 1 THEN 'extends' WHEN 2 THEN 'implements' WHEN 3 THEN 'embeds' WHEN 4 THEN 'calls' ELSE 'imports' END AS kind FROM part) GROUP BY kind")
def edge_weights(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("contains", "extends", "implements", "embeds", "calls", "imports")]), (F.col("p_size") % 6 + 1).cast("int"))
    e = table(spark, d, "part").select(kind.alias("kind")).withColumn("weight", store.edge_weight(F.col("kind")))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
