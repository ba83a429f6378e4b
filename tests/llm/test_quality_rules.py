import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality_rules as q

from .helpers import awkward, clashing, empty

LABELS = "doc_id long, quality int, toxic int"


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts_equal_slow_ones():
    rng = np.random.default_rng(5)
    alphabet = ["a", "b", "é ", " ", "\n", "\n\n", "#", "\x0b", " ", " ", "the ", "cat|", "\x1c"]
    texts = [None, "", " ", "a a a a", "x\nx\ny\nx"] + ["".join(rng.choice(alphabet, rng.integers(1, 120))) for _ in range(1500)]
    for t in texts:
        assert q.base_counts(t) == slow_counts(t), t


def test_cases(spark):
    docs = awkward(spark)
    out = {(r.doc_id, r.n_words): r for r in q.judge(clashing(docs), np.zeros(64), keep=["doc_id"], prefix="").collect()}
    assert out[(1, 0)].base_failed and not out[(1, 0)].kept and out[(1, 0)].score == 0.0
    assert out[(2, 0)].base_failed and out[(6, 40_000)].n_words == 40_000
    assert sum(1 for r in q.judge(docs, np.zeros(64)).collect()) == docs.count()
    assert q.judge(empty(spark), np.zeros(64)).count() == 0


def test_fit_without_trusted_documents_is_neutral(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([(6, 0, 0), (7, 1, 1), (None, 1, 0), (1, None, None)], LABELS)
    assert not q.fit(docs, none).any()
    assert not q.fit(empty(spark), spark.createDataFrame([], LABELS)).any()


def test_fit_counts_every_document(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(8, 1, 0)], LABELS)
    w = q.fit(docs, labels, buckets=128)
    raw, good, hashes = np.ones(128), np.ones(128), q.WordHash()
    for r in docs.collect():
        c = np.bincount(q.ngram_buckets(r.text, hashes, 128), minlength=128)
        raw += c
        good += c * (r.doc_id == 8)
    assert np.allclose(w, np.log(good / good.sum()) - np.log(raw / raw.sum()))


def test_junk_is_rejected_and_good_text_kept(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = q.query(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    labels = labels[~labels.base_failed]
    assert labels[labels.quality == 1].kept.mean() > 0.99
    assert labels[labels.quality == 0].kept.mean() < 0.05


def test_filter_keeps_columns(spark):
    docs = clashing(awkward(spark))
    out = q.filter_documents(docs, spark.createDataFrame([(8, 1, 0)], LABELS))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {8}  # its two texts are the target, so the rest of the corpus is unlike it


def test_threshold_holds_on_labels_it_was_not_fitted_on(spark, sf):
    """A third of the labels, chosen by hash, is kept from the fit; the verdicts on it come from the others alone."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) == 0
    weights = q.fit(docs, labels.filter(~held))
    got = q.judge(docs, weights, keep=["doc_id"]).join(labels.filter(held), "doc_id").filter("not base_failed").toPandas()
    good, junk = got[got.quality == 1], got[got.quality == 0]
    assert len(good) > 60 and len(junk) > 5
    assert good.kept.mean() >= 0.99 and junk.kept.mean() <= 0.1
