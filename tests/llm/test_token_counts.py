import random

import public_tokenizers
import pytest
import sentencepiece

from quarry.llm import token_counts as q

from .helpers import awkward, clashing, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library_on_odd_texts(library):
    rng = random.Random(3)
    alphabet = list(" \n\t▁aeétTh<s>/!0　\x00ñ中🙂. \r​") + ["  ", " the", "</s>", "<unk>", "<0x0A>"]
    lengths = q.Lengths(PATH, {}, most=50)  # a cache that is emptied again and again
    for _ in range(20_000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert lengths.count(t) == len(library.encode(t)), repr(t)


def test_query_equals_the_library(spark, sf, library):
    got = q.query(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    for i, t in zip(docs.doc_id, docs.text):
        n = len(library.encode(t))
        assert (got.n_tokens[i], got.n_bytes[i], got.over_limit[i]) == (n, len(t.encode()), n > 4096)


def test_table_does_not_change_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    a = q.count_tokens(docs, PATH, keep=["doc_id"], tails=(), cache=10).toPandas().sort_values("doc_id")
    b = q.count_tokens(docs, PATH, keep=["doc_id"]).toPandas().sort_values("doc_id")
    assert a.n_tokens.tolist() == b.n_tokens.tolist()


def test_table_holds_lengths_of_the_vocabularys_words(library):
    table = q.frequent(PATH)
    assert 10_000 < len(table) < 3 * library.get_piece_size() and " the" in table and " the." in table
    base = len(library.encode("\n"))
    for pre in sorted(table)[::500]:
        assert table[pre] == len(library.encode("\n" + pre)) - base


def test_cases(spark, library):
    docs = clashing(awkward(spark))
    rows = q.count_tokens(docs, PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_tokens == (len(library.encode(r.text)) if r.text else 0) and r.n_bytes == len((r.text or "").encode())
    assert q.count_tokens(empty(spark), PATH).count() == 0


def test_unfit_vocabularies_are_refused():
    with pytest.raises(Exception):
        q.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
