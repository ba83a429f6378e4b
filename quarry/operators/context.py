"""Context assembly: search hits are expanded along the graph, merged, ranked, annotated, packed and rendered.

Everything up to the packing is one set-based plan over (query_id, hit) rows; the packing is a fold over a query's few hundred
ranked rows at most, run for each query by applyInPandas.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize
from ..functions.embedding import Provider, embed_one
from ..schema import DEPENDENCY_KINDS
from ..sources.adapters import Corpus
from . import search
from .limits import adaptive_k

#: Fixed values: (fan-out, weight) of what a seed depends on, of what those depend on, and of what depends on the seed.
OUT, OUT2, BACK = (5, 0.7), (3, 0.4), (3, 0.6)
ANNOTATED, FULL_SOURCE, HEADER_TOKENS, BUDGET, LEAST_BUDGET = 20, 5, 20, 8000, 2000


def _near(corpus: Corpus, direction: str, top: int) -> Callable[[DataFrame, str], DataFrame]:
    own, other = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    names = corpus.nodes.select(F.col("node_id").alias("to"), F.coalesce("qualified_name", "name").alias("name"))
    edges = corpus.edges.filter(F.col("kind").isin(list(DEPENDENCY_KINDS))).select(F.col(own).alias("from"), F.col(other).alias("to"))

    def hop(ids: DataFrame) -> DataFrame:
        """(from, to, pos): the first `top` neighbours of each id, in the order of their names."""
        # Only the edges of these ids are made distinct, not the whole table.
        some = edges.join(ids.select(F.col("node_id").alias("from")).distinct(), "from").select("from", "to").distinct().join(names, "to")
        return some.withColumn("pos", F.row_number().over(Window.partitionBy("from").orderBy(F.asc_nulls_last("name"), "to"))).filter(F.col("pos") <= top).select("from", "to", "pos")

    return hop


def expand(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """Events (query_id, seed_rank, step, node_id, similarity, weight) of hits (query_id, node_id, similarity, seed_rank)."""
    seeds = hits.select("query_id", "seed_rank", "node_id", "similarity")
    base = seeds.select("query_id", "seed_rank", F.lit(0).alias("step"), "node_id", "similarity", F.lit(1.0).alias("weight"))
    first = seeds.join(_near(corpus, "out", OUT[0])(seeds), F.col("node_id") == F.col("from"))
    one = first.select("query_id", "seed_rank", (F.col("pos") * 10).alias("step"), F.col("to").alias("node_id"), "similarity", F.lit(OUT[1]).alias("weight"))
    one = materialize(one)  # five rows for a seed at most, used twice
    second = one.drop("weight").join(_near(corpus, "out", OUT2[0])(one), F.col("node_id") == F.col("from"))
    two = second.select("query_id", "seed_rank", (F.col("step") + F.col("pos")).alias("step"), F.col("to").alias("node_id"), "similarity", F.lit(OUT2[1]).alias("weight"))
    behind = seeds.join(_near(corpus, "in", BACK[0])(seeds), F.col("node_id") == F.col("from"))
    back = behind.select("query_id", "seed_rank", (F.col("pos") + 100).alias("step"), F.col("to").alias("node_id"), "similarity", F.lit(BACK[1]).alias("weight"))
    return base.unionByName(one).unionByName(two).unionByName(back)


def rank(events: DataFrame) -> DataFrame:
    """(query_id, node_id, similarity, weight, score): each node's best event. A seed that an earlier seed reached
    first counts as a neighbour only; of equal scores the earliest stays."""
    w = Window.partitionBy("query_id", "node_id")
    reached = F.min(F.when(F.col("step") > 0, F.col("seed_rank"))).over(w)
    score = F.col("similarity") * F.col("weight")
    live = events.withColumn("reached", reached).filter((F.col("step") > 0) | F.col("reached").isNull() | (F.col("reached") >= F.col("seed_rank")))
    best = live.withColumn("score", score).withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "seed_rank", "step"))).filter("n = 1")
    return best.select("query_id", "node_id", "similarity", "weight", "score")


def annotations(corpus: Corpus, ids: DataFrame) -> DataFrame:
    """(node_id, called_by, calls, imported_by, imports): labels of the three heaviest neighbours of each sort."""
    label = F.when(F.coalesce("alias", F.lit("")) != "", F.concat("qualified_name", F.lit(" ["), "alias", F.lit("]"))).otherwise(F.col("qualified_name"))
    labels = corpus.nodes.select(F.col("node_id").alias("to"), label.alias("label"))
    e = corpus.edges.filter(F.col("kind").isin("calls", "imports"))
    pick = ids.select("node_id").distinct()
    # Both directions of both kinds at once: one join with the ids, one with the labels, one window.
    both = e.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("to"), F.when(F.col("kind") == "calls", "called_by").otherwise("imported_by").alias("sort"), "weight").unionByName(
        e.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("to"), F.when(F.col("kind") == "calls", "calls").otherwise("imports").alias("sort"), "weight")
    )
    top = both.join(pick, "node_id").join(labels, "to").withColumn("n", F.row_number().over(Window.partitionBy("node_id", "sort").orderBy(F.desc("weight"), "to"))).filter("n <= 3")
    lists = top.groupBy("node_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("sort") == s, F.struct("n", "label")))), lambda x: x["label"]).alias(s) for s in ("called_by", "calls", "imported_by", "imports")])
    none = F.array().cast("array<string>")
    return pick.join(lists, "node_id", "left").select("node_id", *[F.coalesce(s, none).alias(s) for s in ("called_by", "calls", "imported_by", "imports")])


def render_node(n: dict) -> str:
    """A node's section of the context text. A fixed format."""
    source = f" [source: {n['alias']}]" if n["alias"] else ""
    out = [f"### {n['file_path']} — {n['qualified_name']}{source} (similarity: {n['similarity']:.2f})", f"Signature: {n['signature']}"]
    out += [f"Docstring: {n['docstring']}"] if n["docstring"] else []
    for title, key in (("Imported by", "imported_by"), ("Imports", "imports"), ("Called by", "called_by"), ("Calls", "calls")):
        out += [f"{title}: {', '.join(n[key])}"] if len(n[key]) else []
    if n["full_source"] and n["source_code"]:
        out += ["", "```", n["source_code"], "```"]
    return "\n".join(out) + "\n"


def render(nodes: list[dict]) -> str:
    """The context text; nodes are grouped by source in the order of first appearance, unless none has a source."""
    if not nodes:
        return "No relevant code found."
    groups: dict[str, list[dict]] = {}
    for n in nodes:
        groups.setdefault(n["alias"] or "(unknown)", []).append(n)
    flat = list(groups) == ["(unknown)"]
    body = "".join(("" if flat else f"## Source: {a}\n\n") + "".join(render_node(n) + "\n" for n in g) for a, g in groups.items())
    return "## Relevant Code\n\n" + body


def byte_tokens(text: str) -> int:
    return len(text.encode()) // 4


def pack(ranked: list[dict], budget: int, count: Callable[[str], int] = byte_tokens) -> tuple[list[dict], int]:
    """The longest prefix of ranked nodes that fits the budget, and its tokens. The first five carry their source; one
    that does not fit with it is tried without; the first that does not fit at all ends the list."""
    kept, used = [], HEADER_TOKENS
    for i, n in enumerate(ranked):
        for full in [True, False] if i < FULL_SOURCE and n["source_code"] else [i < FULL_SOURCE]:
            trial = n | {"full_source": full, "source_code": n["source_code"] if full else ""}
            cost = count(render_node(trial))
            if used + cost <= budget:
                kept.append(trial)
                used += cost
                break
        else:
            break
    return kept, used - HEADER_TOKENS


def _ranked(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """The ranked nodes of each query with their columns, place and notes."""
    best = rank(expand(corpus, hits))
    cols = [F.coalesce(c, F.lit("")).alias(c) if c in corpus.nodes.columns else F.lit("").alias(c) for c in ("file_path", "signature", "docstring", "source_code", "alias")]
    wide = best.join(corpus.nodes.select("node_id", F.coalesce("qualified_name", "name").alias("qualified_name"), *cols), "node_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "qualified_name", "node_id")
    wide = materialize(wide.withColumn("place", F.row_number().over(order)))  # a few hundred rows a query, used twice
    notes = annotations(corpus, wide.filter(F.col("place") <= ANNOTATED))
    none = F.array().cast("array<string>")
    four = ["called_by", "calls", "imported_by", "imports"]
    return wide.join(notes, "node_id", "left").select(*wide.columns, *[F.when(F.col("place") <= ANNOTATED, F.coalesce(c, none)).otherwise(none).alias(c) for c in four])


def packed(corpus: Corpus, hits: DataFrame, budget: int = BUDGET, count: Callable[[str], int] = byte_tokens) -> DataFrame:
    """(query_id, place, node_id, full_source): the nodes that each query's context holds, in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, _ = pack(pdf.sort_values("place").to_dict("records"), budget, count)
        return pd.DataFrame([(n["query_id"], n["place"], n["node_id"], n["full_source"]) for n in kept], columns=["query_id", "place", "node_id", "full_source"])

    rows = _ranked(corpus, hits)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("query_id", "node_id")]
    return rows.groupBy("query_id").applyInPandas(fold, f"query_id {kinds[0]}, place int, node_id {kinds[1]}, full_source boolean")


def assemble(corpus: Corpus, hits: DataFrame, budget: int = BUDGET, count: Callable[[str], int] = byte_tokens, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, n_nodes, n_tokens, token_limit, text) for each query of hits, and for each of `queries` (query_id), if given: one without
    hits has the fixed text. Each query has the whole budget."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, _ = pack(pdf.sort_values("place").to_dict("records"), budget, count)
        text = render(kept)
        return pd.DataFrame([{"query_id": pdf["query_id"].iloc[0], "n_nodes": len(kept), "n_tokens": count(text), "token_limit": budget, "text": text}])

    kind = hits.schema["query_id"].dataType.simpleString()
    out = _ranked(corpus, hits).groupBy("query_id").applyInPandas(fold, f"query_id {kind}, n_nodes long, n_tokens long, token_limit long, text string")
    if queries is None:
        return out
    rest = [F.coalesce("n_nodes", F.lit(0).cast("long")).alias("n_nodes"), F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.lit(budget).cast("long").alias("token_limit"), F.coalesce("text", F.lit(render([]))).alias("text")]
    return queries.select("query_id").join(out, "query_id", "left").select("query_id", *rest)


def explore_budget(budget: int, queries: int) -> int:
    return max(budget // max(queries, 1), LEAST_BUDGET)


# From texts to contexts.


def text_hits(corpus: Corpus, provider: Provider, texts: dict[int, str], project=None, keywords=None) -> tuple[DataFrame, dict[int, str]]:
    """The hits of each text (query_id, node_id, similarity, seed_rank), as many as the project's size asks for, and the texts that
    failed, with their errors. Texts are parameters: a few, embedded by the driver. Similarity is the fused score."""
    size = corpus.nodes.filter(F.col("project_id") == project).count() if project is not None else corpus.nodes.count()
    found, errors = None, {}
    for i, text in texts.items():
        try:
            vector = embed_one(provider, text)
        except Exception as x:  # noqa: BLE001 - one text's failure is its own section
            errors[i] = str(x)
            continue
        top = search.hybrid_topk(corpus.nodes, vector, text, project=project, limit=adaptive_k(size), keywords=keywords)
        top = top.select(F.lit(i).alias("query_id"), "node_id", F.col("score").alias("similarity"))
        found = top if found is None else found.unionByName(top)
    if found is None:
        found = corpus.nodes.select(F.lit(0).alias("query_id"), "node_id", F.lit(0.0).alias("similarity")).limit(0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node_id"))  # of 25 rows at most
    return materialize(found.withColumn("seed_rank", place)), errors


def explore(corpus: Corpus, provider: Provider, texts: list[str], project=None, budget: int | None = None, count: Callable[[str], int] = byte_tokens, keywords=None) -> DataFrame:
    """(query_id, query, n_nodes, n_tokens, token_limit, text, error) for each text; several share the budget, with a least one for each. The
    budget is the default if none is given or it is not positive."""
    if not texts:
        raise ValueError("no query")
    budget = BUDGET if not budget or budget <= 0 else budget
    each = budget if len(texts) == 1 else explore_budget(budget, len(texts))
    hits, errors = text_hits(corpus, provider, dict(enumerate(texts, 1)), project, keywords)
    spark = corpus.nodes.sparkSession
    asked = spark.createDataFrame([(i, t, errors.get(i)) for i, t in enumerate(texts, 1)], "query_id int, query string, error string")
    out = assemble(corpus, hits, each, count, asked.select("query_id"))
    text = F.when(F.col("error").isNull(), F.col("text"))
    return asked.join(out, "query_id").select("query_id", "query", "n_nodes", "n_tokens", "token_limit", text.alias("text"), "error")


def explore_text(rows: list) -> str:
    """The one text of explore()'s rows: the context of a single query as it is, sections for several. A fixed format."""
    rows = sorted(rows, key=lambda r: r["query_id"])
    if len(rows) == 1:
        if rows[0]["error"]:
            raise RuntimeError(rows[0]["error"])
        return rows[0]["text"]
    parts = [f"## Query {r['query_id']}: {r['query']}\n\n" + (f"Error: {r['error']}\n\n" if r["error"] else f"{r['text']}\n\n---\n\n") for r in rows]
    return "".join(parts)


def distinct_sources(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Each node's first row in `order` (for each of `by`), as the list of sources of an answer names it once."""
    key = [*(by or []), "node_id"]
    rest = [*order, *[c for c in rows.columns if c not in key and c not in order]]
    first = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_f"))
    return first.select(*[c if c in key else F.col(f"_f.{c}").alias(c) for c in rows.columns])


def preamble(projects: DataFrame, sources: DataFrame, workspaces: DataFrame, packages: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, text) for each project: its name and description, its sources with up to five package names each, and how
    many symbols and relationships it has. A fixed format."""
    ws = workspaces.select(F.col("id").alias("workspace_id"), "source_id", "project_id")
    names = packages.select("workspace_id", "name").join(ws, "workspace_id").groupBy("source_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    n = F.size("names")
    some = F.array_join(F.slice("names", 1, 5), ", ")
    listed = F.when(n > 5, F.concat(F.lit(" — "), n, F.lit(" packages: "), some, F.lit(", ..."))).when(n > 0, F.concat(F.lit(" — "), n, F.when(n == 1, " package: ").otherwise(" packages: "), some)).otherwise("")
    line = F.concat(F.lit("- "), F.coalesce("alias", F.lit("")), F.lit(" ("), "source_type", F.lit(")"), listed, F.lit("\n"))
    lines = sources.join(names, sources["id"] == names["source_id"], "left").select("project_id", F.struct(F.coalesce("alias", F.lit("")).alias("alias"), line.alias("line")).alias("s"))
    lines = lines.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "").alias("lines"))
    own = nodes.select("node_id", "workspace_id").join(ws.select("workspace_id", "project_id"), "workspace_id")
    n_nodes = own.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    n_edges = edges.select(F.col("source_id").alias("node_id")).join(own.select("node_id", "project_id"), "node_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_edges"))
    p = projects.select(F.col("id").alias("project_id"), "name", F.coalesce("description", F.lit("")).alias("description"))
    p = p.join(lines, "project_id", "left").join(n_nodes, "project_id", "left").join(n_edges, "project_id", "left")
    text = F.concat(
        F.lit("## Project: "), "name", F.lit("\n"),
        F.when(F.col("description") != "", F.concat(F.lit("Description: "), "description", F.lit("\n"))).otherwise(""),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n### Sources\n"), "lines")).otherwise(""),
        F.when(F.col("n_nodes") > 0, F.concat(F.lit("\n### Stats\n"), "n_nodes", F.lit(" code symbols, "), F.coalesce("n_edges", F.lit(0)), F.lit(" relationships\n"))).otherwise(""),
    )
    return p.select("project_id", text.alias("text"))
