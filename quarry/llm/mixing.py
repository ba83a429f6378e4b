"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' contents of a tree domain - language - source. A leaf offers its tokens
`epochs` times; a node offers what its children offer. The token budget goes down the tree: a node
gives its children shares in proportion to their weights, a child that offers less than its
share takes all it offers, and what it leaves goes to its siblings in proportion (water-filling).
As a node never gets more than its subtree offers, a shortage reaches an ancestor's
other children only when all siblings are full. Shares are whole tokens, rounded down.

A leaf's share is met by full epochs and a prefix of one more: the documents in the order of
md5(seed:epoch:id), as long as the tokens before them are less than what is left; the one that
crosses the share is the last. The place where the prefix ends is found in two steps: sums over the 4096 values of the
order's first three digits name the one part in which it ends, and only that part's keys are put in order. So a leaf
with a third of all documents is spread over 4096 groups, and texts are read once more to be filtered by their leaf's last key: they are not
shuffled where the leaves' table is small enough to be broadcast (its rows are counted), nor are a hot leaf's in any case.
All arithmetic is on integers.

Defined cases. A document has ceil(UTF-8 bytes / 4) tokens (the reading of this measure that needs no
vocabulary) unless tokens_col names a column of counts (null: 0); null texts have 0 and are chosen like others. Null domain, language
or source is the node 'none'. Null ids order as 'none'. Rows that tie in the order (repeated ids) are chosen together.
Nodes without a weight have weight 1; a weight of 0 leaves the subtree out, negative weights are refused.
A leaf without tokens offers nothing. A budget above what is offered gives all epochs of all other leaves. Empty tables: no rows.
Result: all columns of docs, with domain, epoch (from 0) and n_tokens; a column of docs that has one of these three names gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_first, materialize, read, without

LEVELS = ["domain", "lang", "source"]
EPOCHS = 2
SEED = 17
#: The query's targets: 3/5 of the corpus' tokens, domains 5 : 3 : 2, English twice any other language.
BUDGET = (3, 5)
DOMAIN_WEIGHTS = {"web": 5, "ref": 3, "code": 2}
LANG_WEIGHTS = {"en": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
#: Up to this many leaves (of about 100 bytes) their table is broadcast.
BROADCAST_ROWS = 200_000


def n_tokens(text: Column) -> Column:
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4).cast("long")


def _weight(node: Column, weights: dict[str, int]) -> Column:
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(node == name, F.lit(w).cast("long")).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent..., name, w, cap, budget of the parent) with `share`: the water-filling of each parent's budget."""
    near = Window.partitionBy(*parent, *([] if parent else [F.lit(0)])).orderBy(F.col("cap") / F.col("w"), name)
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*parent, *([] if parent else [F.lit(0)]))
    t = nodes.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("full", F.col("cap") * F.col("w0") <= F.col("w") * (F.col("budget") - F.col("c0")))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of)
    rest = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(all_of)
    t = t.withColumn("left", left).withColumn("rest", rest)
    return t.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("w * left div nullif(rest, 0)"))).drop("c0", "w0", "full", "left", "rest")


def shares(leaves: DataFrame, budget: Column, epochs: int, weights: list[dict[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens, share) of leaves (domain, lang, source, tokens)."""
    levels = LEVELS
    t = leaves
    for name, w in zip(levels, weights):
        t = t.withColumn(f"w_{name}", _weight(F.col(name), w))
    t = t.filter("w_domain > 0 and w_lang > 0 and w_source > 0").withColumn("cap", F.col("tokens") * epochs)
    top = t.groupBy().agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    given = top.select(F.least("cap", budget).cast("long").alias("budget"))
    for k, name in enumerate(levels):
        parent = levels[:k]
        nodes = t.groupBy(*parent, name).agg(F.sum("cap").alias("cap"), F.first(f"w_{name}").alias("w"))
        nodes = nodes.join(given, parent) if parent else nodes.join(F.broadcast(given))  # one row
        given = fill(nodes, parent, name).select(*parent, name, F.col("share").alias("budget"))
    return t.join(given.withColumnRenamed("budget", "share"), levels).select(*levels, "tokens", "share")


def _key(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("none"))))


def _at_leaves(rows: DataFrame, plan: DataFrame, keys: list[str], broadcast_rows: int) -> DataFrame:
    """rows joined to a stored table of leaves, whose n_docs tells how many rows each has."""
    if plan.count() <= broadcast_rows:
        return rows.join(F.broadcast(plan), keys)
    return join_first(rows, plan, keys, "n_docs")


def mix_sources(docs: DataFrame, domain: Column, *, budget: Column, epochs: int = EPOCHS, seed: int = SEED, weights: list[dict[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tokens_col: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The chosen (document, epoch) rows, with all columns of docs. budget: in tokens; may use the column `tokens`, those of all documents.
    domain: of the columns of docs."""
    weights = weights or [{}, {}, {}]
    named = [F.coalesce(c.cast("string"), F.lit("none")).alias(n) for n, c in zip(LEVELS, (domain, docs[lang_col], docs[source_col]))]
    n = F.coalesce(docs[tokens_col].cast("long"), F.lit(0)) if tokens_col else n_tokens(docs[text_col])
    src = docs.select(docs[id_col].alias("doc"), *named, n.alias("n"))
    leaves = materialize(src.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("n_docs")))
    plan = shares(leaves, budget, epochs, weights).join(leaves.select(*LEVELS, "n_docs"), LEVELS)
    plan = plan.withColumn("epoch", F.least(F.expr("coalesce(share div nullif(tokens, 0), 0)"), F.lit(epochs).cast("long"))).withColumn("more", F.col("share") - F.col("epoch") * F.col("tokens"))
    plan = materialize(plan.select(*LEVELS, "n_docs", "epoch", "more"))

    # The part in which each leaf's prefix ends, and the tokens before it.
    rows = _at_leaves(src, plan, LEVELS, broadcast_rows).filter("more > 0").withColumn("key", _key(seed, F.col("epoch"), F.col("doc")))
    parts = rows.groupBy(*LEVELS, "more", F.substring("key", 1, 3).alias("part")).agg(F.sum("n").alias("held"))
    before = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0))).filter("ahead < more")
    ends = ends.groupBy(*LEVELS).agg(F.max_by(F.struct("part", "ahead"), "part").alias("end")).select(*LEVELS, "end.part", "end.ahead")
    plan = materialize(plan.join(ends, LEVELS, "left"))

    # The last key of the prefix: rows that tie are in it together.
    rows = _at_leaves(src, plan, LEVELS, broadcast_rows).withColumn("key", _key(seed, F.col("epoch"), F.col("doc"))).filter(F.substring("key", 1, 3) == F.col("part"))
    keys = rows.groupBy(*LEVELS, "ahead", "more", "key").agg(F.sum("n").alias("n"))
    keys = keys.withColumn("before", F.col("ahead") + F.coalesce(F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = keys.filter("before < more").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    plan = materialize(plan.select(*LEVELS, "n_docs", "epoch").join(last, LEVELS, "left"))

    names = fresh(docs, *(f"quarry_{x}" for x in (*LEVELS, "epoch", "last", "n")))
    whole = docs.select(*docs.columns, *[c.alias(x) for c, x in zip(named, names)], n.alias(names[5]))
    plan = plan.select(*[F.col(c).alias(x) for c, x in zip((*LEVELS, "epoch", "last"), names)], "n_docs")
    out = _at_leaves(whole, plan, names[:3], broadcast_rows)
    times = F.col(names[3]) + F.when(_key(seed, F.col(names[3]), F.col(id_col)) <= F.col(names[4]), 1).otherwise(0)
    out = out.filter(times > 0)
    kept = without(docs.columns, ["domain", "epoch", "n_tokens"])
    return out.select(*kept, F.col(names[0]).alias("domain"), F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("epoch"), F.col(names[5]).alias("n_tokens"))


def domain_of(source: Column) -> Column:
    """The query's domains: the number in a source's name modulo 3."""
    n = F.pmod(F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0)), F.lit(3))
    return F.when(n == 0, "web").when(n == 1, "ref").otherwise("code")


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix_sources(docs, domain_of(docs["source"]), budget=F.expr(f"tokens * {BUDGET[0]} div {BUDGET[1]}"), weights=[DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS])


def query(spark, sf_dir) -> DataFrame:
    out = mix_documents(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "domain", *[F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")], "epoch", "n_tokens")


def _level(k: int) -> str:
    """SQL of the shares at the k-th level: the same water-filling, written out."""
    levels = ["domain", "lang", "source"]
    parent, name = levels[:k], levels[k]
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    on = " AND ".join(f"n.{p} = g.{p}" for p in parent) or "TRUE"
    cols = ", ".join([*parent, name])
    return f"""
n{k} AS (SELECT {cols}, sum(cap)::BIGINT AS cap, max(w_{name}) AS w FROM leaf GROUP BY {cols}),
b{k} AS (SELECT n.*, g.budget FROM n{k} n JOIN g{k} g ON {on}),
o{k} AS (SELECT *, coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c0,
  (sum(w) OVER ({part}))::BIGINT - coalesce(sum(w) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w0
  FROM b{k} WINDOW b AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {name})),
f{k} AS (SELECT *, cap * w0 <= w * (budget - c0) AS filled FROM o{k}),
r{k} AS (SELECT *, budget - (sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({part}))::BIGINT AS remain,
  (sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}))::BIGINT AS rest FROM f{k}),
g{k + 1} AS (SELECT {cols}, CASE WHEN filled THEN cap ELSE (w * remain) // nullif(rest, 0) END AS budget FROM r{k}),"""


def _case(col: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


ORACLE_SQL = f"""
WITH src AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'ref' ELSE 'code' END AS domain,
    ((coalesce(strlen(text), 0) + 3) // 4)::BIGINT AS n
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {EPOCHS})::BIGINT AS cap,
  ({_case("domain", DOMAIN_WEIGHTS)})::BIGINT AS w_domain, ({_case("lang", LANG_WEIGHTS)})::BIGINT AS w_lang, ({_case("source", SOURCE_WEIGHTS)})::BIGINT AS w_source
  FROM src GROUP BY domain, lang, source),
g0 AS (SELECT least(sum(cap), sum(tokens) * {BUDGET[0]} // {BUDGET[1]})::BIGINT AS budget FROM leaf),
{"".join(_level(k) for k in range(3))}
plan AS (SELECT l.domain, l.lang, l.source, l.tokens, g.budget AS share, least(coalesce(g.budget // nullif(l.tokens, 0), 0), {EPOCHS})::BIGINT AS epoch
  FROM leaf l JOIN g3 g ON l.domain = g.domain AND l.lang = g.lang AND l.source = g.source),
keyed AS (SELECT s.*, p.epoch, p.share - p.epoch * p.tokens AS more,
  md5('{SEED}:' || p.epoch::VARCHAR || ':' || coalesce(s.doc_id::VARCHAR, 'none')) AS key
  FROM src s JOIN plan p ON s.domain = p.domain AND s.lang = p.lang AND s.source = p.source),
summed AS (SELECT *, (sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT
  - (sum(n) OVER (PARTITION BY domain, lang, source, key))::BIGINT AS before FROM keyed),
picked AS (SELECT *, epoch - 1 + CASE WHEN before < more THEN 1 ELSE 0 END AS last FROM summed),
steps AS (SELECT unnest(range({EPOCHS}))::BIGINT AS epoch)
SELECT p.doc_id, p.domain, p.lang, p.source, e.epoch, p.n AS n_tokens FROM picked p JOIN steps e ON e.epoch <= p.last
"""
