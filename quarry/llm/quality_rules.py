"""Quality rules: a log-likelihood ratio of hashed n-grams under two multinomials.

Each text is cut into lower-case runs of word characters and runs of punctuation; their
unigrams and bigrams are hashed into `buckets`. Two multinomials over the buckets are
counted: the raw corpus (every document) and a trusted target (labelled documents of good
quality that are not toxic). A document's score is the mean over its n-grams of
log p_target - log p_raw, both with add-one smoothing; it is kept at `threshold` or more.
At the default -0.1 an n-gram may on average be a tenth less likely under the target than under
the raw corpus: labelled good documents lie at -0.02 and above, labelled junk at -0.6 and below.

Counting the raw corpus covers all documents. The target is fitted on `trusted_limit`
labelled documents at most (a fixed pseudo-random choice by hash of the id), whose ids are
broadcast: a bounded set.

Defined cases. Null or empty text: no words, base_failed, score 0. Without labels, or where
no labelled document is trusted, the target equals the raw corpus and only base rules decide.
Repeated rows are judged alike. Null labels are not trusted. doc_id null: scored, never trusted.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHash, fresh, mix, per_text, read, slices

BUCKETS = 1 << 14
TRUSTED_LIMIT = 20_000
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        lines = [x for x in lines if x.strip(_SPACES)]
        dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        d = len(ids)
        if d < 1 << 21:
            code = (seq[:-2] * d + seq[1:-1]) * d + seq[2:]
        else:  # pair numbers first, so that the code stays within 64 bits
            code = np.unique(seq[:-2] * d + seq[1:-1], return_inverse=True)[1] * d + seq[2:]
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, dup, repeated


def base_failed(n_words: int, n_repeat_words: int, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> bool:
    return n_words < min_words or 100 * n_repeat_words > max_repeat * n_words


def ngram_buckets(text: str | None, hashes: WordHash, buckets: int) -> np.ndarray:
    """The bucket of each unigram and bigram of a whole text."""
    if not text:
        return np.empty(0, np.int64)
    h = hashes.of(_TOKENS.findall(text.lower()))
    hashes.trim()
    both = np.concatenate([mix(h), mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])]) if len(h) else h
    return (both % U64(buckets)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, trusted_limit: int = TRUSTED_LIMIT) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    trusted = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    trusted = trusted.select(F.col("doc_id").alias("q_id")).distinct().orderBy(F.xxhash64("q_id"), "q_id").limit(trusted_limit)
    flagged = docs.select(docs[id_col].alias("q_doc"), docs[text_col].alias("q_text"))
    # At most trusted_limit ids: the one broadcast, bounded by that parameter.
    flagged = flagged.join(F.broadcast(trusted), F.col("q_doc") == F.col("q_id"), "left").select("q_text", F.col("q_id").isNotNull().alias("q_on"))

    def count(batches):
        import pyarrow as pa

        raw, good, hashes = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), WordHash()
        for b in slices(batches):
            for text, on in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.bincount(ngram_buckets(text, hashes, buckets), minlength=buckets)
                raw += c
                if on:
                    good += c
        (at,) = np.nonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    raw, good = np.ones(buckets), np.ones(buckets)
    for row in flagged.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # a row for each bucket at most
        raw[row["bucket"]] += row["raw"]
        good[row["bucket"]] += row["good"]
    if good.sum() == buckets:
        return np.zeros(buckets)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """docs (its columns `keep`) with FIELDS, each named with `prefix` before it."""

    def kernel():
        hashes = WordHash()

        def run(texts):
            rows = []
            for text in texts:
                base = base_counts(text)
                at = ngram_buckets(text, hashes, len(weights))
                score = float(weights[at].mean()) if len(at) else 0.0
                failed = base_failed(base[0], base[4])
                rows.append((*base, failed, score, not failed and score >= threshold))
            return list(zip(*rows)) if rows else [()] * 8

        return run

    fields = ", ".join(prefix + x.strip() for x in FIELDS.split(","))
    return per_text(docs, text_col, fields, kernel, keep)


def filter_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    weights = fit(docs, labels, **params)
    prefix = fresh(docs, "quarry_q_")[0]
    return judge(docs, weights, prefix=prefix).filter(F.col(prefix + "kept")).select(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
