import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.vectors import cosine
from quarry.operators import context, graph, limits, resolve, search, store
from quarry.sources.adapters import Corpus

NODE = "node_id string, qualified_name string, name string, kind string, file_path string, start_line int, alias string, project_id int, package_id string, signature string, docstring string, source_code string"
EDGE = "source_id string, target_id string, kind string, weight double"


@pytest.fixture(scope="module")
def corpus(spark):
    """A chain of three calls below main, a side branch, an import, and a class apart."""
    names = [("main", "function", "a"), ("load", "function", "a"), ("parse", "function", "b"), ("lex", "function", "b"), ("log", "function", "b"), ("Config", "class", "b")]
    nodes = spark.createDataFrame([(f"n{i}", n, n, k, f"{p}/f{i % 2}.ts", 10 * i, "repo" if p == "a" else None, 1, p, f"sig {n}", None, "body " * 5) for i, (n, k, p) in enumerate(names)], NODE)
    edges = spark.createDataFrame([("n0", "n1", "calls", 0.5), ("n1", "n2", "calls", 0.5), ("n2", "n3", "calls", 0.5), ("n0", "n4", "calls", 0.9), ("n1", "n5", "imports", 0.5), ("n3", "n1", "calls", 0.1), ("n0", "n0", "contains", 1.0)], EDGE)
    return Corpus(nodes, edges, None, None)


def ids(df):
    return [r.node_id for r in df.collect()]


def test_clamps():
    assert [limits.clamp_limit(x) for x in (None, 0, -1, 7, 101)] == [10, 10, 10, 7, 100]
    assert [limits.candidate_limit(x) for x in (10, 67, 100)] == [30, 200, 200]
    assert [limits.clamp_depth(x) for x in (None, 0, 3, 11)] == [5, 5, 3, 10]
    assert [limits.adaptive_k(x) for x in (0, 999, 1000, 4999, 5000, 14999, 15000)] == [10, 10, 15, 15, 20, 20, 25]


def test_depths_and_cycles(corpus):
    got = {r.qualified_name: r.min_depth for r in graph.reachable(corpus, "n0", "out", 5, 100).collect()}
    assert got == {"load": 1, "log": 1, "parse": 2, "Config": 2, "lex": 3}
    assert {r.node_id: r.min_depth for r in graph.reachable(corpus, "n1", "out", 5, 100).collect()}["n1"] == 3
    assert ids(graph.reachable(corpus, "n0", "out", 1, 100)) == ["n1", "n4"]
    assert graph.reachable(corpus, "missing", "out").count() == 0
    assert {r.node_id for r in graph.reachable(corpus, "n3", "in", 2, 100).collect()} == {"n2", "n1"}


def test_structural_dispatch(corpus):
    assert ids(graph.structural(corpus, 1, "load", "callers")) == ["n0", "n3"]
    assert ids(graph.structural(corpus, 1, "main", "callees")) == ["n4", "n1"]
    assert ids(graph.structural(corpus, 1, "Config", "importers")) == ["n1"]
    assert graph.structural(corpus, 1, "nope", "dependencies").count() == 0
    assert ids(graph.structural(corpus, 1, "main", "dependencies", kinds=["class"])) == ["n5"]
    with pytest.raises(ValueError):
        graph.structural(corpus, 1, "main", "cousins")


def test_reports(corpus):
    assert {r.node_id: r.degree for r in graph.project_nodes(corpus, 1).collect()} == {"n0": 2, "n1": 4, "n2": 2, "n3": 2, "n4": 1, "n5": 1}
    assert graph.project_edges(corpus, 1).count() == 6
    assert [(r.source_id, r.target_id) for r in graph.cross_package(corpus, "a", "b").collect()] == [("n0", "n4"), ("n1", "n2"), ("n1", "n5")]
    assert graph.node_detail(corpus, 1, "n1").first().callers == 2 and graph.node_detail(corpus, 2, "n1").first() is None


def test_context(corpus, spark):
    hits = spark.createDataFrame([(1, "n0", 0.9, 1), (1, "n1", 0.8, 2)], "query_id int, node_id string, similarity double, seed_rank int")
    best = {r.node_id: r for r in context.rank(context.expand(corpus, hits)).collect()}
    assert best["n0"].score == pytest.approx(0.9) and best["n1"].score == pytest.approx(0.63)  # reached by the first seed before
    row = context.assemble(corpus, hits, 8000).first()
    assert row.n_nodes == len(best) and row.text.startswith("## Relevant Code\n\n## Source: repo\n\n### a/f0.ts — main [source: repo] (similarity: 0.90)\n")
    tight = context.assemble(corpus, hits, 60).first()
    assert 0 < tight.n_nodes < len(best) and tight.n_tokens <= 60
    assert context.assemble(corpus, hits, 5).first().text == "No relevant code found."
    assert context.explore_budget(8000, 5) == 2000 and context.explore_budget(8000, 2) == 4000


def test_pack_tries_without_source_then_stops():
    n = {"qualified_name": "q", "file_path": "f", "signature": "s", "docstring": "", "alias": "", "similarity": 1.0, "called_by": [], "calls": [], "imported_by": [], "imports": []}
    kept, _ = context.pack([n | {"source_code": "x" * 4000}, n | {"source_code": ""}], 60)
    assert [k["full_source"] for k in kept] == [False, True] and kept[0]["source_code"] == ""


def test_cosine(spark):
    cases = [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([c for *_, c in cases])


def test_search(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}", "k", [1.0 if j == i else 0.0 for j in range(4)], 1) for i in range(4)] + [("n9", "name 2 other", "z", None, 1)], "node_id string, name string, kind string, embedding array<float>, project_id int")
    assert ids(search.semantic_topk(nodes, [0.0, 1.0, 0.0, 0.0], project=1, limit=1)) == ["n1"]
    assert search.semantic_topk(nodes, [0.0, 1.0, 0.0, 0.0], project=2).count() == 0
    assert set(ids(search.keyword_leg(nodes, "Name 2"))) == {"n2", "n9"} and search.keyword_leg(nodes, "!!").count() == 0
    top = search.hybrid_topk(nodes, [0.0, 0.0, 1.0, 0.0], "2", limit=5).orderBy(F.desc("score")).first()
    assert top.node_id == "n2" and top.score == pytest.approx(2 / 61)
    assert ids(search.approximate_topk(search.cells(nodes.filter("embedding is not null"), [[1.0, 0, 0, 0], [0, 0, 1.0, 0]]), [[1.0, 0, 0, 0], [0, 0, 1.0, 0]], [0, 0, 1.0, 0], probes=1, limit=1)) == ["n2"]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_approximate_topk(spark, sf, size):
    """Against all rows, over every vector whose id is divisible by 100."""
    import numpy as np

    from quarry.plans import registry

    d = sf.replace("sf0.001", size)
    got = {}
    for r in registry.QUERIES["approximate_topk"](spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.node_id)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    recall = [len(got[q] & set(ids[np.lexsort((ids, -(x @ v)))[:10]])) / 10 for q, v in zip(ids, x) if q % 100 == 0]
    print(size, len(recall), sum(recall) / len(recall))
    assert len(recall) == len(got) >= 5 and sum(recall) / len(recall) >= 0.9


def test_store(spark):
    e = spark.createDataFrame([("a", "b", "calls", 0.5, 1), ("a", "b", "calls", 1.0, 3), ("a", "b", "calls", 1.0, 2)], EDGE + ", ordinal int")
    assert store.dedup_max(e).first().ordinal == 2
    old = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "z", "r"), (3, None, "s")], "id int, v string, w string")
    assert sorted(map(tuple, store.upsert(old, new, ["id"], ["v"]).collect())) == [(1, "x", "p"), (2, "z", "q"), (3, None, "s")]
    d = store.diff_snapshots(spark.createDataFrame([("a", "1"), ("b", "1")], "path string, digest string"), spark.createDataFrame([("b", "2"), ("c", "1")], "path string, digest string"))
    assert {(r.path, r.change) for r in d.collect()} == {("a", "deleted"), ("b", "modified"), ("c", "added")}
    assert store.over_threshold(d, 2) and not store.over_threshold(d, 3) and not store.over_threshold(d, 0) and not store.over_threshold(d, 2, full=True)
    rows = spark.createDataFrame([("n", "f"), ("m", "g")], "node_id string, file_path string")
    kept, stale = store.prune_stale(rows, rows.filter("file_path = 'f'").select("file_path"))
    assert ids(kept) == ["n"] and ids(stale) == ["m"] and store.prune_stale(rows, rows.limit(0))[1].count() == 2


def test_text_functions(spark):
    df = spark.createDataFrame([(s,) for s in ("@co/pkg/sub/x", "@co/pkg", "lodash/fp", "react", "@scope")], "s string")
    assert [tuple(r) for r in df.select(tx.specifier_package(F.col("s")), tx.specifier_subpath(F.col("s"))).collect()][:4] == [("@co/pkg", "sub/x"), ("@co/pkg", ""), ("lodash", "fp"), ("react", "")]
    p = spark.createDataFrame([(s,) for s in ("packages/core/src/a.ts", "x/internal/api/b.go", "cmd/tool/c.go", "src/a.ts")], "s string")
    assert [r[0] for r in p.select(tx.package_dir(F.col("s"))).collect()] == ["packages/core", "x/internal/api", "cmd/tool", ""]
    assert df.limit(1).select(tx.body_hash(F.lit("x"))).first()[0] == hashlib.sha256(b"x").hexdigest()
    assert [tx.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "happy", "conditional", "adjustable", "running")] == ["caress", "poni", "relat", "hop", "agre", "happi", "condit", "adjust", "run"]
    enc, dec = (lambda s: list(s)), "".join
    assert tx.truncate_input("sig", "doc", "source", enc, dec, 100) == ("sig\ndoc\nsource", 14, False)
    assert tx.truncate_input("sig", "doc", "source", enc, dec, 10) == ("sig\ndoc\nsou", 10, True)
    assert tx.truncate_input("signature", "doc", "source", enc, dec, 5) == ("signa", 5, True)


def test_longest_prefix_against_loop(spark):
    rng = random.Random(2)
    seg = lambda n: "/".join(rng.choice("abc") for _ in range(n))
    paths = sorted({seg(rng.randint(1, 5)) for _ in range(80)})
    owners = sorted({(seg(rng.randint(1, 3)), rng.randrange(4)) for _ in range(12)} | {(".", 9)})
    got = {r.path: (r.prefix, r.owner) for r in resolve.longest_prefix(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(owners, "prefix string, owner int"), "path", "prefix").collect()}
    for p in paths:
        fit = [(o, w) for o, w in owners if o == "." or p == o or p.startswith(o + "/")]
        best = max(len(o) if o != "." else 0 for o, _ in fit)
        assert got[p] == min((o, w) for o, w in fit if (len(o) if o != "." else 0) == best)


def test_resolution(spark):
    files = spark.createDataFrame([(f,) for f in ("src/a.ts", "src/util/index.ts", "packages/core/index.ts", "lib/b.js", "lib/c.tsx")], "file_path string")
    imports = spark.createDataFrame([(1, "src/a.ts", "./util"), (2, "src/a.ts", "@x/core"), (3, "src/util/index.ts", "../a"), (4, "src/a.ts", "fs"), (5, "src/a.ts", "left-pad"), (6, "lib/c.tsx", "./b"), (7, "src/util/index.ts", "../../lib/c.js"), (8, "x.go", "fmt")], "id int, file_path string, specifier string")
    aliases = spark.createDataFrame([("@x/core", "packages/core"), ("@x", "nowhere")], "alias string, target string")
    done, open_ = resolve.resolve_imports(imports, aliases, files)
    assert {r.id: r.resolved_path for r in done.collect()} == {1: "src/util/index.ts", 2: "packages/core/index.ts", 3: "src/a.ts", 6: "lib/b.js", 7: "lib/c.tsx"}
    assert [r.id for r in open_.collect()] == [5]
    nodes = spark.createDataFrame([("n1", "f1", "go"), ("n2", "f2", "go"), ("n3", "f2", "only"), ("n4", "f3", "split")], "node_id string, file_path string, name string")
    calls = spark.createDataFrame([(1, "f1", "go"), (2, "f4", "go"), (3, "f4", "x.only"), (4, "f4", "s.split"), (5, "f4", "console.log"), (6, "f5", "go")], "id int, file_path string, callee string")
    got = {r.id: (r.target_id, r.tier) for r in resolve.resolve_calls(calls, nodes, spark.createDataFrame([("f4", "f2")], "file_path string, resolved_path string")).collect()}
    assert got == {1: ("n1", 1), 2: ("n2", 2), 3: ("n3", 2)}


def join_rows(df):
    """The most rows that a join of an executed plan made."""
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        name = p.nodeName()
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            left.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(p.plan())
        kids = p.children()
        left += [kids.apply(i) for i in range(kids.size())]
    return most


def test_calls_of_a_frequent_name_do_not_multiply(spark):
    """300 symbols of one name in a file, and 400 calls of it there and in a file that imports it."""
    nodes = spark.range(300).selectExpr("concat('n', id) AS node_id", "'f1' AS file_path", "'go' AS name")
    more = spark.createDataFrame([("n900", "f3", "once"), ("n901", None, "lone"), ("n902", "f4", "lone2"), ("n903", None, "lone2")], "node_id string, file_path string, name string")
    calls = spark.range(800).selectExpr("id", "CASE WHEN id < 400 THEN 'f1' ELSE 'f2' END AS file_path", "'x.go' AS callee")
    odd = spark.createDataFrame([(900, None, "once"), (901, None, "go"), (902, "f1", None), (903, "f9", "lone"), (904, "f9", "lone2"), (5, "f9", "once"), (905, "f9", "once"), (905, "f2", "go")], "id long, file_path string, callee string")
    imports = spark.createDataFrame([("f2", "f1", ["go"]), ("f2", "f1", ["* as x"]), ("f2", "f3", ["other"])], "file_path string, resolved_path string, symbols array<string>")
    got = resolve.resolve_calls(calls.unionByName(odd), nodes.unionByName(more), imports)
    rows = {r.id: (r.target_id, r.tier) for r in got.collect()}
    want = {i: ("n0", 1 if i < 400 else 2) for i in range(800)}
    assert rows == want | {900: ("n900", 3), 903: ("n901", 3), 905: ("n0", 2)}
    assert join_rows(got) <= 810
