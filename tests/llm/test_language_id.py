import itertools
import math
import zlib

import numpy as np
import public_tokenizers

from quarry.llm import language_id as q

from .helpers import awkward, clashing, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, pieces, p):
    """The probability of a word: the sum over all its cuts."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[start:i])
                start = i
        one = 1.0
        for s in parts:
            one *= p[pieces.index(s)] if s in pieces else (q.UNKNOWN if len(s) == 1 else 0.0)
        total += one
    return total


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab"])
    p = np.random.default_rng(2).dirichlet(np.ones(len(pieces)))
    lattice = q.Lattice(pieces)
    for w in ("abab", "baab", "xaba", "b"):
        got = lattice.forward(["▁" + w], lattice.scaled(p)[:, None])[0, 0]
        assert math.isclose(got, math.log(all_segmentations("▁" + w, pieces, p)), rel_tol=1e-9)


def test_expected_counts_are_posterior_means():
    pieces = sorted(["▁", "a", "b", "ab", "▁a"])
    p = np.random.default_rng(3).dirichlet(np.ones(len(pieces)))
    lattice = q.Lattice(pieces)
    counts = lattice.expected(["▁abab"], np.array([2.0]), lattice.scaled(p))
    assert math.isclose(sum(counts[i] * len(x) for i, x in enumerate(pieces)), 2 * 5, rel_tol=1e-9)


def test_long_words_do_not_underflow():
    lattice = q.Lattice(["▁", "a"])
    out = lattice.forward(["▁" + "a" * 200], lattice.scaled(np.array([0.9, 0.1]))[:, None])
    assert np.isfinite(out).all() and abs(out[0, 0] - 200 * math.log(0.1) - math.log(0.9)) < 1e-6


def test_long_words_are_scored_whole():
    """Against the same sum in logarithms; a word of parts would differ at the cuts."""
    rng = np.random.default_rng(4)
    pieces = sorted(["▁", "a", "b", "ab", "ba", "aba", "bb"])
    p = rng.dirichlet(np.ones(len(pieces)))
    word = "▁" + "".join(rng.choice(["a", "b", "x"], 5000, p=[0.5, 0.45, 0.05]))
    log = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        terms = [log[i] + math.log(p[pieces.index(s)] if s in pieces else q.UNKNOWN) for i in range(max(0, j - 3), j) if (s := word[i:j]) in pieces or len(s) == 1]
        top = max(terms)
        log[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    lattice = q.Lattice(pieces)
    assert math.isclose(lattice.forward([word], lattice.scaled(p)[:, None])[0, 0], log[-1], rel_tol=1e-9)
    counts = lattice.expected([word], np.array([1.0]), lattice.scaled(p))
    assert math.isclose(sum(counts[i] * len(x) for i, x in enumerate(pieces)) + counts[lattice.unknown], len(word), rel_tol=1e-6)


def test_prediction_and_posterior_equal_brute_force():
    """Of whole texts, with a hand-made model of two languages."""
    pieces = sorted(["▁", "a", "b", "ab", "▁a"])
    rng = np.random.default_rng(6)
    model = q.Model(["x", "y"], pieces, rng.dirichlet(np.ones(len(pieces)), 2))
    texts = ["ab ba 12 A", "b b b ab", "", None, "77 !"]
    langs, scores = q.Scorer(model).predict(texts)
    for t, lang, score in zip(texts, langs, scores):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        both = [math.prod(all_segmentations("▁" + w, pieces, p) for w in words) for p in model.p]
        assert lang == ("x" if both[0] >= both[1] else "y") and math.isclose(score, max(both) / sum(both), rel_tol=1e-9)


def test_too_many_labels_and_repeated_ids(spark):
    import pytest

    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        q.fit(docs, PATH, max_languages=4)
    same = spark.createDataFrame([(1, "aa bb", "x")] * 50 + [(2, "cc dd", "y")], "doc_id long, text string, lang string")
    assert q.fit(same, PATH, per_language=1).langs == ["x", "y"]


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = q.query(spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().merge(got, on="doc_id")
    held = docs[docs.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98
    assert docs.score.between(0, 1).all()


def test_cases(spark):
    docs = clashing(awkward(spark, [(50, "ein deutscher text mit wörtern und sätzen", "de", "s", 1), (51, "x" * 5000, "de", "s", 1), (52, "½ ² _ 7", "en", "s", 1)]))
    model = q.fit(docs, PATH, rounds=1)
    assert model.langs == ["de", "en"]
    rows = q.identify(docs, model).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 52):
        assert by[i].lang_pred == "und" and by[i].score == 0.0
    assert by[5].lang_pred == "und" and by[50].lang_pred == "de" and by[51].lang_pred in ("de", "en")
    none = q.fit(empty(spark), PATH)
    assert none.langs == [] and {r.lang_pred for r in q.identify(docs, none).collect()} == {"und"}
    assert q.identify(empty(spark), model).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"wort{chr(97 + i % 26)}", "de") for i in range(500)], "doc_id long, text string, lang string")
    model = q.fit(docs, PATH, per_language=5, rounds=1)
    assert model.langs == ["de"]
