"""Embedding providers, stored postings, and the way from texts to contexts."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import embedding
from quarry.functions.text import stem
from quarry.operators import context, fulltext, search
from quarry.sources import adapters
from quarry.sources.adapters import Corpus

NODES = "node_id string, name string, qualified_name string, kind string, file_path string, start_line int, project_id int, alias string, signature string, docstring string, source_code string"


def corpus(spark):
    rows = [
        ("n1", "validateUser", "auth.validateUser", "function", "auth.ts", 1, 1, "api", "function validateUser(u)", "Validates running users", "return check(u)"),
        ("n2", "runQueries", "db.runQueries", "function", "db.ts", 2, 1, "api", "function runQueries()", "Runs the queries of a user", "query()"),
        ("n3", "Cache", "cache.Cache", "class", "cache.ts", 3, 1, "lib", "class Cache", None, "x = 1"),
        ("n4", "other", "o.other", "function", "o.ts", 4, 2, "web", "function other()", "validate", ""),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    nodes = embedding.embed_nodes(nodes, embedding.Hashed(32))
    edges = spark.createDataFrame([("n1", "n2", "calls", 0.5), ("n2", "n3", "uses_type", 0.5)], "source_id string, target_id string, kind string, weight double")
    return Corpus(nodes, edges, None, None)


def test_backoff_doubles_up_to_a_bound():
    middle = [embedding.backoff(i, lambda: 0.5) for i in range(9)]
    assert middle[:4] == [1, 2, 4, 8] and middle[-1] == 60
    assert embedding.backoff(1, lambda: 0.0) == 1.5 and embedding.backoff(1, lambda: 1.0) == 2.5


def test_busy_is_retried_and_other_errors_are_raised():
    calls, waits = [], []

    def provider(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise embedding.Busy("429")
        return [(1, [2.0]), (0, [1.0])]  # out of order

    assert embedding.embed(provider, ["a", "b"], waits.append) == [[1.0], [2.0]] and len(waits) == 2
    assert embedding.embed(provider, []) == [] and len(calls) == 3

    def broken(texts):
        raise KeyError("x")

    with pytest.raises(KeyError):
        embedding.embed(broken, ["a"], waits.append)

    def always(texts):
        raise embedding.Busy("503")

    waits.clear()
    with pytest.raises(embedding.Busy):
        embedding.embed(always, ["a"], waits.append)
    assert len(waits) == embedding.TRIES - 1
    with pytest.raises(ValueError):
        embedding.embed(lambda t: [], ["a"])


def test_batches_are_bounded():
    assert list(embedding.batches(["a" * 4] * 5, len, tokens=8, rows=3)) == [[0, 1], [2, 3], [4]]
    assert list(embedding.batches(["x"] * 5, len, tokens=99, rows=2)) == [[0, 1], [2, 3], [4]]
    assert list(embedding.batches(["x" * 50, "y"], len, tokens=8)) == [[0], [1]] and list(embedding.batches([], len)) == []


def test_nodes_keep_their_vectors_and_long_inputs_are_cut(spark):
    ddl = "node_id string, signature string, docstring string, source_code string, embedding array<float>"
    rows = [("a", "sig", None, "body", [9.0]), ("b", "sig", "doc", "s" * 100_000, None), ("c", None, None, "", None)]
    # A provider that tells the length of what it got.
    got = {r.node_id: r.embedding for r in embedding.embed_nodes(spark.createDataFrame(rows, ddl), lambda texts: [(i, [float(len(t.encode()))]) for i, t in enumerate(texts)]).collect()}
    assert got["a"] == [9.0] and got["c"] is None and got["b"][0] <= 4 * embedding.INPUT_TOKENS + 8
    assert embedding.embed_nodes(spark.createDataFrame([], ddl), embedding.Hashed()).count() == 0


def test_stemmed_postings(spark, tmp_path):
    c = corpus(spark)
    path = f"file://{tmp_path}/postings"
    fulltext.store(fulltext.postings(c.nodes), path)
    stored = fulltext.load(spark, path)
    ids = lambda q: sorted(r.node_id for r in fulltext.match(stored, q).collect())
    assert ids("query") == ids("the queries") == ["n2"] and ids("run user") == ["n1", "n2"] and ids("validates") == ["n1", "n4"]
    assert ids("the of and") == [] and ids("") == [] and ids("absent query") == []
    assert stem("running") == "run" and fulltext.terms("The running of RUNS") == ["run"]
    plan = fulltext.match(stored, "query")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    ranked = {r.node_id: r.rank for r in fulltext.match(fulltext.postings(c.nodes), "validateuser").collect()}
    assert ranked == {"n1": 1.0}
    top = search.hybrid_search(c.nodes, embedding.Hashed(32), "queries of a user", project=1, keywords=fulltext.leg(stored)).orderBy(F.desc("score")).collect()
    assert top[0].node_id == "n2" and {r.node_id for r in top} == {"n1", "n2", "n3"}
    assert search.semantic_search(c.nodes, embedding.Hashed(32), "class Cache", limit=1).first().node_id == "n3"


def test_contexts_of_texts(spark):
    c = corpus(spark)
    rows = context.explore(c, embedding.Hashed(32), ["runs the queries of a user"], 1).collect()
    assert len(rows) == 1 and rows[0].n_nodes == 3 and "auth.validateUser [source: api]" in rows[0].text.replace("### db.ts", "") and rows[0].token_limit == 8000
    text = context.explore_text(rows)
    assert text.startswith("## Relevant Code\n\n## Source: api\n\n### db.ts — db.runQueries [source: api] (similarity: ")

    class Picky(embedding.Hashed):
        def __call__(self, texts):
            if texts == ["bad"]:
                raise ValueError("no such model")
            return super().__call__(texts)

    rows = context.explore(c, Picky(32), ["queries", "bad", "cache"], 1, 3000).collect()
    assert {r.token_limit for r in rows} == {2000} and [r.error for r in sorted(rows, key=lambda r: r.query_id)] == [None, "no such model", None]
    text = context.explore_text(rows)
    assert "## Query 2: bad\n\nError: no such model\n\n## Query 3: cache\n\n## Relevant Code" in text and text.endswith("\n\n---\n\n")
    with pytest.raises(ValueError):
        context.explore(c, Picky(32), [])


def test_an_empty_project_gives_the_fixed_text(spark):
    c = corpus(spark)
    row = context.explore(c, embedding.Hashed(32), ["queries"], 99, -1).first()
    assert (row.text, row.n_nodes, row.n_tokens, row.token_limit) == ("No relevant code found.", 0, 0, 8000)


def test_cells_hold_every_vector_once(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(f"v{i}", [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [("none", None)]
    nodes = spark.createDataFrame(rows, "node_id string, embedding array<float>")
    centres = search.fit_centres(nodes, lists=10)
    assert centres.shape == (10, 8)
    path = f"file://{tmp_path}/cells"
    search.store_cells(search.cells(nodes, centres), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 300 and stored.select("node_id").distinct().count() == 300
    exact = [r.node_id for r in search.vector_leg(nodes, rows[5][1], 10).orderBy(F.desc("similarity"), "node_id").collect()]
    assert [r.node_id for r in search.approximate_topk(stored, centres, rows[5][1], probes=10).orderBy(F.desc("similarity"), "node_id").collect()] == exact
    few = search.approximate_topk(stored, centres, rows[5][1], probes=2)
    assert few.first().node_id == "v5" and "PartitionFilters: [cell" in few._jdf.queryExecution().executedPlan().toString().replace("isnotnull(cell", "cell")
    q = spark.createDataFrame([(1, rows[5][1]), (2, rows[6][1]), (3, None)], "query_id int, vector array<float>")
    each = search.approximate_topk_each(stored, centres, q, probes=10).collect()
    assert sorted(r.node_id for r in each if r.query_id == 1) == sorted(exact) and {r.query_id for r in each} == {1, 2}
    assert search.fit_centres(nodes.limit(0)).shape[0] == 0


def test_postings_are_made_without_a_shuffle(spark, sf):
    """Words meet within their row; nodes of the same id are merged by the search."""
    rows = [("n1", "getUser", "auth.getUser user", "user auth sig", "user auth sig doc doc"), ("n2", None, None, "a the", "the b"), ("n3", "x", None, None, None), ("n3", None, None, "y", "x"), ("n3", "y", None, None, None), ("n4", "", None, None, "")]
    nodes = spark.createDataFrame(rows, "node_id string, name string, qualified_name string, signature string, docstring string")
    plain = fulltext.postings(nodes, stemmed=False)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.node_id, r.lexeme, r.weight) for r in plain.filter("node_id < 'n3'").collect())
    assert got == [("n1", "auth", 1.0), ("n1", "doc", 0.2), ("n1", "getuser", 1.0), ("n1", "sig", 0.4), ("n1", "user", 1.0), ("n2", "a", 0.4), ("n2", "b", 0.2), ("n2", "the", 0.4)]
    assert [tuple(r) for r in fulltext.match(plain, "x y", stemmed=False).collect()] == [("n3", 1.0)]
    assert fulltext.match(plain, "x y z", stemmed=False).count() == 0
    ranks = {r.node_id: r.rank for r in fulltext.match(fulltext.postings(nodes), "sigs docs").collect()}
    assert ranks == {"n1": pytest.approx(0.3)}
    weights = {"docstring": 0.5, "name": 0.1}
    assert {(r.lexeme, r.weight) for r in fulltext.postings(nodes, weights, False).filter("node_id = 'n3'").collect()} == {("x", 0.5), ("x", 0.1), ("y", 0.1)}
    assert "Join" not in adapters.texts(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_a_word_of_every_node_is_stored_by_several_tasks(spark, tmp_path):
    """Shares over the advisory size are split, beyond the eight that a bucket is dealt over."""
    nodes = spark.range(0, 40_000, 1, 16).selectExpr("concat('n', id) AS node_id", "'same' AS name")
    key, path = "spark.sql.adaptive.advisoryPartitionSizeInBytes", f"file://{tmp_path}/postings"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        fulltext.store(fulltext.postings(nodes, stemmed=False), path)
    finally:
        spark.conf.set(key, before)
    stored = fulltext.load(spark, path)
    assert stored.count() == stored.select("node_id").distinct().count() == 40_000
    assert stored.select(F.input_file_name()).distinct().count() > 16
    assert fulltext.match(stored, "same", stemmed=False).count() == 40_000
