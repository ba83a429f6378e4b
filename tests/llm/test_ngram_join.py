import random
from fractions import Fraction

import numpy as np

from quarry.llm import ngram_join as q

from .helpers import awkward, clashing, empty


def shingle_set(text, width=5):
    w = text.split(" ") if text else []
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def slow(rows):
    """{id: (class, links, copies)} of rows (id, text)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(shingle_set(t), []).append(i)
    keys = list(groups)
    root, links = list(range(len(keys))), [0] * len(keys)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(keys)):
        for b in range(a):
            n = len(keys[a] & keys[b])
            if keys[a] and keys[b] and 5 * n >= 4 * len(keys[a] | keys[b]):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for a, k in enumerate(keys):
        least[top(a)] = min([least.get(top(a), 1 << 60), *groups[k]])
    return {i: (least[top(a)], links[a], len(groups[k]) - 1) for a, k in enumerate(keys) for i in groups[k]}


def corpus(rng, families, members, words, edits, shared=()):
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join([*w, *shared])))
    return rows


def run(spark, rows, **params):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc: (r["class"], r.n_links, r.n_copies) for r in q.similar(docs, **params).collect()}


def test_equals_brute_force(spark):
    rows = corpus(random.Random(1), 60, 4, 120, 5)
    assert run(spark, rows) == slow(rows)


def test_one_large_group_is_compared_in_blocks(spark):
    rows = corpus(random.Random(2), 1, 150, 150, 5)
    assert run(spark, rows, bucket=32) == slow(rows)


def test_recall_when_every_bucket_is_split(spark):
    """All documents share a passage, so hot buckets must be split to the end: links at the threshold survive."""
    rng = random.Random(4)
    rows = corpus(rng, 80, 3, 100, 3, shared=[f"hot{i}" for i in range(60)])
    want, got = slow(rows), run(spark, rows, bucket=8)
    total = sum(v[1] for v in want.values())
    assert total > 100
    assert sum(v[1] for v in got.values()) >= 0.99 * total
    assert all(got[i][1] <= want[i][1] for i in want)


def test_runs_follow_from_the_target_recall(spark):
    assert q.runs_for(0.9995, 0.8, 2.0, 2.0, 5) == 8 and q.missed(0.8, 2.0, 2.0, 5) ** 8 < 5e-4
    assert q.runs_for(0.99, 0.8, 2.0, 2.0, 5) < 8 < q.runs_for(0.9995, 0.5, 2.0, 2.0, 5)


def test_splits_to_the_last_level_reach_the_target(spark):
    """Simulated: the paths that pairs at the threshold share after five splits of every bucket."""
    rng = np.random.default_rng(5)
    lost, pairs = 0, 1500
    for _ in range(pairs):
        common, more = rng.integers(1, 2**63, 160, dtype=np.uint64), rng.integers(1, 2**63, 40, dtype=np.uint64)
        a, b = np.unique(np.r_[common, more[:20]]), np.unique(np.r_[common, more[20:]])
        x, y = ([(int(i) << 32) | int(s[i]) for i in np.nonzero(s)[0]] for s in (q.sketch(a), q.sketch(b)))
        x, y = np.array(x, np.uint64), np.array(y, np.uint64)
        paths = {p for r in range(q.runs_for(0.9, 0.8, 2.0, 2.0, 5)) for p in set(q.chosen(a, r, 2.0).tolist()) & set(q.chosen(b, r, 2.0).tolist())}
        for _ in range(5):
            paths = set(list({c for p in paths for c in set(q.chosen(x, p, 2.0).tolist()) & set(q.chosen(y, p, 2.0).tolist())})[:50])
        lost += not paths
    assert lost / pairs <= 0.1 * 1.3


def test_a_block_is_bounded_by_shingles(spark):
    rows = corpus(random.Random(2), 1, 60, 150, 5)
    assert run(spark, rows, tokens=1000) == slow(rows)


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(12)]
    got = q.common_counts(sets)
    for a in range(12):
        for b in range(a):
            assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_cases(spark):
    base = " ".join(f"t{i}" for i in range(100))
    docs = awkward(spark, [(30, base, "en", "s", 1), (31, base + " extra", "en", "s", 1), (None, base + " other", "en", "s", 1), (32, "one", "en", "s", 1)])
    out = q.similar(clashing(docs)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc, []).append(r)
    assert by[30][0]["class"] == by[31][0]["class"] == 30 and by[30][0].n_links == 2
    assert [r["class"] for r in by[None] if r.n_links] == [30]
    assert by[4][0]["class"] == by[32][0]["class"] == 4 and by[4][0].n_copies == 1
    assert by[1][0]["class"] == 1 and by[1][0].n_copies == by[2][0].n_copies == 0
    assert len(by[8]) == 2 and len(by[7]) == 1 and by[7][0].n_copies == 1
    assert q.similar(empty(spark)).count() == 0


def test_keep_one(spark):
    base = " ".join(f"t{i}" for i in range(100))
    docs = clashing(awkward(spark, [(30, base, "en", "s", 1), (31, base + " extra", "en", "s", 1)]))
    out = q.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 30 in ids and 31 not in ids and ids.count(7) == 2 and ids.count(8) == 2 and {1, 2, 3, 4} <= set(ids)


def test_threshold_is_exact(spark):
    a = " ".join(f"a{i}" for i in range(13))  # 9 shingles
    b = a + " x"  # 10 shingles: 9/10
    got = run(spark, [(1, a), (2, b)], threshold=Fraction(9, 10))
    assert got[2][0] == 1
    assert run(spark, [(1, a), (2, b)], threshold=Fraction(91, 100))[2][0] == 2
