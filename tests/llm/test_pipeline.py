import re

import corpus_pipeline
import numpy as np

from quarry.llm import decontaminate, mixing, quality_rules

from .helpers import awkward, clashing
from .test_line_dedup import slow as slow_lines
from .test_mixing import slow_mix
from .test_ngram_join import slow as slow_classes
from .test_quality_rules import slow_counts


def test_equals_brute_force(spark, sf):
    """Each stage computed again by plain loops; the run's rows must be those."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    rows = list(docs[["doc_id", "text", "lang", "source"]].itertuples(index=False, name=None))

    trusted = set(labels.doc_id[(labels.quality == 1) & (labels.toxic != 1)])
    hashes, size = quality_rules.WordHash(), quality_rules.BUCKETS
    at = {i: quality_rules.ngram_buckets(t, hashes, size) for i, t, *_ in rows}
    raw = 1.0 + sum(np.bincount(x, minlength=size) for x in at.values())
    good = 1.0 + sum(np.bincount(at[i], minlength=size) for i in trusted)
    weight = np.log(good / good.sum()) - np.log(raw / raw.sum())
    kept = []
    for r in rows:
        n, *_, repeated = slow_counts(r[1])
        if n >= 50 and 100 * repeated <= 50 * n and weight[at[r[0]]].mean() >= quality_rules.THRESHOLD:
            kept.append(r)

    texts = slow_lines([r[:2] for r in kept])
    kept = [(r[0], t, *r[2:]) for r, t in zip(kept, texts) if t == r[1] or re.search(r"\S", t)]
    classes = slow_classes([(r[0], " ".join(r[1].split())) for r in kept])
    kept = [r for r in kept if classes[r[0]][0] == r[0]]
    kept = [r for r in kept if not any(t in r[1] for t in items.text)]
    mixed = [(i, (len(t.encode()) + 3) // 4, ["web", "ref", "code"][int(s[3:]) % 3], la, s) for i, t, la, s in kept]
    total = sum(r[1] for r in mixed)
    want = slow_mix(mixed, total * 3 // 5, mixing.EPOCHS, mixing.SEED, [mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS])

    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.epoch) for r in got} == want and len(got) == len(want) > 20
    texts = {r[0]: r[1] for r in kept}
    assert all(r.text == texts[r.doc_id] and r.n_tokens == (len(r.text.encode()) + 3) // 4 for r in got)
    assert {"doc_id", "text", "lang", "source", "n_chars", "domain", "epoch", "n_tokens"} == set(got[0].asDict())


def test_stages_keep_the_columns(spark, sf):
    docs = clashing(awkward(spark)).withColumn("extra", spark.range(1).selectExpr("1").columns and __import__("pyspark").sql.functions.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert "extra" in docs.columns and "n_chars" in docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.columns == [*docs.columns, "domain", "epoch", "n_tokens"]


def test_what_stages_wrote_on_the_way_is_deleted(spark, sf):
    from pathlib import Path

    from quarry.llm.common import shared_dir

    root = Path(shared_dir(spark).removeprefix("file://"))
    before = set(root.iterdir())
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 20 and len(set(root.iterdir()) - before) <= 5


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources"]
    assert decontaminate.WINDOW == 8
