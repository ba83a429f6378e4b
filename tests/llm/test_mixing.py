import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing as q

from .helpers import awkward, clashing, empty


def slow_fill(budget, children):
    """{name: share} of children {name: (weight, cap)}, one saturation at a time."""
    left, open_ = budget, dict(children)
    out = {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = sorted((n for n, (w, c) in open_.items() if c * total <= w * left), key=lambda n: (open_[n][1] / open_[n][0], n))
        if not full:
            return out | {n: w * left // total for n, (w, _) in open_.items()}
        out[full[0]] = open_[full[0]][1]
        left -= open_.pop(full[0])[1]
    return out


def slow_mix(rows, budget, epochs, seed, weights):
    """{(id, epoch)} of rows (id, tokens, domain, lang, source) with distinct ids."""
    leaves = {}
    for i, n, *path in rows:
        leaves.setdefault(tuple(path), []).append((i, n))
    weight = lambda k, name: weights[k].get(name, 1)
    leaves = {p: v for p, v in leaves.items() if all(weight(k, x) for k, x in enumerate(p))}
    cap = {}
    for p, docs in leaves.items():
        for k in range(4):
            cap[p[:k]] = cap.get(p[:k], 0) + epochs * sum(n for _, n in docs)
    share = {(): min(budget, cap.get((), 0))}
    for k in range(3):
        for parent in {p[:k] for p in leaves}:
            kids = {p[k] for p in leaves if p[:k] == parent}
            got = slow_fill(share[parent], {x: (weight(k, x), cap[(*parent, x)]) for x in kids})
            share |= {(*parent, x): s for x, s in got.items()}
    out = set()
    for p, docs in leaves.items():
        tokens = sum(n for _, n in docs)
        full = min(share[p] // tokens if tokens else 0, epochs)
        out |= {(i, e) for i, _ in docs for e in range(full)}
        left = share[p] - full * tokens
        for i, n in sorted(docs, key=lambda d: hashlib.md5(f"{seed}:{full}:{d[0]}".encode()).hexdigest()):
            if left <= 0:
                break
            out.add((i, full))
            left -= n
    return out


@pytest.mark.parametrize("case", range(6))
def test_equals_brute_force(spark, case):
    rng = random.Random(case)
    rows = [(i, rng.randrange(1, 60), f"d{rng.randrange(3)}", rng.choice("abc"), f"s{min(rng.randrange(9), 4)}") for i in range(400)]
    weights = [{"d0": 5, "d1": rng.randrange(4)}, {"a": 7}, {"s1": 30, "s2": 0 if case % 2 else 2}]
    budget = rng.choice([0, 10, 700, 5000, 9000, 10**6])
    docs = spark.createDataFrame([(i, "x" * (4 * n), d, la, s) for i, n, d, la, s in rows], "doc_id long, text string, dom string, lang string, source string")
    got = q.mix_sources(docs, docs["dom"], budget=F.lit(budget), epochs=3, seed=5, weights=weights).collect()
    assert {(r.doc_id, r.epoch) for r in got} == slow_mix(rows, budget, 3, 5, weights)
    assert len(got) == len({(r.doc_id, r.epoch) for r in got})
    texts = {i: "x" * (4 * n) for i, n, *_ in rows}
    assert all(r.text == texts[r.doc_id] and r.n_tokens * 4 == len(r.text) and r.dom == r.domain for r in got)


def test_leaves_beyond_the_broadcast_and_counted_tokens(spark):
    rows = [(i, "y", "d", "en", f"s{i % 7}", i % 5 + 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, source string, tokens int")
    got = q.mix_sources(docs, docs["dom"], budget=F.lit(444), epochs=2, seed=3, tokens_col="tokens", broadcast_rows=0).collect()
    assert {(r.doc_id, r.epoch) for r in got} == slow_mix([(i, n, d, la, s) for i, _, d, la, s, n in rows], 444, 2, 3, [{}, {}, {}])


def test_shortage_goes_to_siblings_first(spark):
    rows = [(0, "x" * 400, "a", "en", "s0"), (1, "x" * 40, "a", "en", "s1"), (2, "x" * 4000, "b", "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, source string")
    leaves = q.shares(docs.select(F.col("dom").alias("domain"), "lang", "source", q.n_tokens(docs["text"]).alias("tokens")), F.lit(160), 1, [{}, {}, {}])
    assert {r.source: r.share for r in leaves.collect()} == {"s0": 70, "s1": 10, "s2": 80}


def test_oracle(spark, sf):
    got = q.query(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(q.ORACLE_SQL).df()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_cases(spark):
    docs = clashing(awkward(spark))
    out = q.mix_documents(docs)
    assert out.columns == [*docs.columns, "domain", "epoch", "n_tokens"]
    rows = out.collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert all((r.doc_id, r.text) in texts for r in rows)
    every = q.mix_sources(docs.withColumn("Epoch", F.lit("x")), docs["source"], budget=F.expr("tokens * 2"))
    assert every.columns == [*docs.columns, "domain", "epoch", "n_tokens"]
    every = every.collect()
    assert any(r.source is None and r.domain == "none" for r in every)
    twice = [r.epoch for r in rows if r.doc_id == 7]
    assert len(twice) % 2 == 0  # rows that tie are chosen together
    assert q.mix_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        q.mix_sources(docs, docs["source"], budget=F.lit(1), weights=[{"a": -1}, {}, {}])


def test_budget_is_met(spark, sf):
    got = q.query(spark, sf).toPandas()
    total = spark.read.parquet(f"{sf}/documents.parquet").select(F.sum(q.n_tokens(F.col("text")))).first()[0]
    assert abs(got.n_tokens.sum() - total * 3 // 5) < 0.35 * total
