"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. A word (a lower-case run of
letters, with the vocabulary's word mark before it) has in each language the probability of
all its segmentations into pieces together, by the forward algorithm; a text has the product over its
words. The prediction is the most probable language under equal priors, the score its posterior.

Piece probabilities are fitted by expectation maximisation (forward-backward over the same segmentations)
on `per_language` labelled documents of each language at most: those with the least hash
of the id, a bounded sample. Characters that no piece covers have the same small probability everywhere.
Words are scored once and kept in a bounded cache by each worker. The forward pass keeps a window of rows as wide as the longest
piece and rescales it as it goes, so a run of letters of any length is scored as one word.

Defined cases. Null text, or one without a letter: `und`, score 0. No labelled documents at all: likewise.
Ties go to the language that is first in alphabetical order. Null labels are not learned from, nor documents with a null id, which are
not held out either. Repeated rows get the same prediction, and count once in the sample. More than `max_languages` different labels are
an error, since the sample and the model grow with them. Very long texts: their words are scored in groups; memory grows with
the longest run of letters only.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_text, read

PER_LANGUAGE = 200
ROUNDS = 4
SMOOTHING = 0.05
UNKNOWN = 1e-7
MAX_LANGUAGES = 1000
CACHE = 300_000
#: Pieces' probabilities are multiplied by this for each of their characters, so that sums stay near 1.
_SCALE = 16.0

_WORDS = re.compile(r"[^\W\d_]+")


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without the word mark, as they are on lower-case text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return sorted(p for p in found if p == p.lower() and p.count("▁") <= 1 and (p.lstrip("▁").isalpha() or p == "▁"))


def words_of(text: str | None) -> list[str]:
    words = _WORDS.findall(text.lower()) if text else []
    if not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
        return []
    return words


class Lattice:
    """Segmentations of words into pieces. Piece numbers: len(pieces) is an unknown character, one more is no piece."""

    def __init__(self, pieces: list[str]):
        self.at = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.scale = np.array([_SCALE ** len(p) for p in pieces] + [_SCALE, 0.0])
        self.unknown = len(pieces)

    def ending(self, words: list[str], j: int):
        """(i, piece numbers of the words' characters i to j) for words of one length; all with the mark."""
        get, none = self.at.get, self.unknown + 1
        for i in range(max(0, j - self.longest), j):
            miss = self.unknown if j == i + 1 else none
            ids = [get(w[i:j], miss) for w in words]
            if miss == self.unknown or any(x != none for x in ids):
                yield i, np.array(ids)

    def arcs(self, words: list[str]):
        """(i, j, piece numbers) of all arcs."""
        return ((i, j, ids) for j in range(1, len(words[0]) + 1) for i, ids in self.ending(words, j))

    def by_length(self, words: list[str], most: int = 4096):
        groups = defaultdict(list)
        for w in words:
            groups[len(w)].append("▁" + w)
        for same in groups.values():
            for k in range(0, len(same), most):
                yield same[k : k + most]

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probabilities (words x languages) of words of one length; p: scaled probabilities (pieces + 2) x languages."""
        m, k = len(words[0]), self.longest + 1
        a = np.zeros((k, len(words), p.shape[1]))  # the last rows, row j at j modulo k
        a[0] = 1.0
        log = np.zeros(a.shape[1:])
        for j in range(1, m + 1):
            now = np.zeros(a.shape[1:])
            for i, ids in self.ending(words, j):
                now += a[i % k] * p[ids]
            a[j % k] = now
            if j % 16 == 0:  # unknown characters alone lose at most 96 decimal places between
                top = np.maximum(a.max(0), 1e-300)
                a /= top
                log += np.log(top)
        return np.log(np.maximum(a[m % k], 1e-300)) + log - m * np.log(_SCALE)

    def expected(self, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in weighted words of one length; p: scaled probabilities. Row j of the forward pass is kept as
        a[j] * exp(up[j]), row i of the backward pass as b[i] * exp(down[i])."""
        m, arcs = len(words[0]), list(self.arcs(words))
        a, b = np.zeros((m + 1, len(words))), np.zeros((m + 1, len(words)))
        up, down = np.zeros((m + 1, len(words))), np.zeros((m + 1, len(words)))
        a[0] = b[m] = 1.0
        into, out_of = defaultdict(list), defaultdict(list)
        for i, j, ids in arcs:
            into[j].append((i, ids))
            out_of[i].append((j, ids))

        def row(values: np.ndarray, logs: np.ndarray, at: int, near: list) -> None:
            top = np.max([logs[k] for k, _ in near], 0)
            total = sum(values[k] * p[ids] * np.exp(logs[k] - top) for k, ids in near)
            size = np.maximum(total, 1e-300)
            values[at], logs[at] = total / size, top + np.log(size)

        for j in range(1, m + 1):
            row(a, up, j, into[j])
        for i in range(m - 1, -1, -1):
            row(b, down, i, out_of[i])
        out = np.zeros(len(p))
        for i, j, ids in arcs:
            out += np.bincount(ids, weight * a[i] * p[ids] * b[j] * np.exp(up[i] + down[j] - up[m]), len(p))
        return out

    def scaled(self, probability: np.ndarray) -> np.ndarray:
        full = np.concatenate([probability, np.array([UNKNOWN, 0.0])])
        return full * self.scale


def fit_language(lattice: Lattice, counts: Counter, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Piece probabilities from the counts of a language's words."""
    n = lattice.unknown
    p = np.full(n, 1.0 / n)
    groups = [(g, np.array([counts[w[1:]] for w in g], float)) for g in lattice.by_length(sorted(counts))]
    for _ in range(rounds):
        total = np.zeros(n)
        for words, weight in groups:
            total += lattice.expected(words, weight, lattice.scaled(p))[:n]
        p = (total + smoothing) / (total.sum() + smoothing * n)
    return p


class Model:
    """Languages, and each one's piece probabilities."""

    def __init__(self, langs: list[str], pieces: list[str], p: np.ndarray):
        self.langs, self.pieces, self.p = langs, pieces, p


class Scorer:
    """Scores whole texts; keeps the scores of words, `most` of them between batches."""

    def __init__(self, model: Model, most: int = CACHE):
        # Fewer words of many languages; in letters, 64 for each word.
        self.model, self.most, self.lattice = model, most // max(1, len(model.langs) // 8), Lattice(model.pieces)
        self.p = np.stack([self.lattice.scaled(x) for x in model.p], 1) if len(model.langs) else None
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.letters = 0
        self.rows = np.empty((0, len(self.model.langs)))

    def full(self) -> bool:
        return len(self.at) > self.most or self.letters > 64 * self.most

    def learn(self, words: set[str]) -> None:
        new, made = [], []
        for group in self.lattice.by_length(sorted(words)):
            new += [w[1:] for w in group]
            made.append(self.lattice.forward(group, self.p))
        self.letters += sum(map(len, new))
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, *made])

    def log_likelihoods(self, texts: list[list[str]]) -> list[np.ndarray]:
        if self.full():
            self.forget()
        out = []
        for words in texts:
            fresh_words = {w for w in words if w not in self.at}
            if fresh_words:
                self.learn(fresh_words)
            ids = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            out.append(self.rows[ids].sum(0, dtype=np.float64))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.model.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        words = [words_of(t) for t in texts]
        if not self.full():  # words of the batch at once
            self.learn({w for x in words for w in x if w not in self.at})
        langs, scores = [], []
        for x, ll in zip(words, self.log_likelihoods(words)):
            if not x:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(ll.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(1.0 / np.exp(ll - ll[best]).sum()))
        return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, rounds: int = ROUNDS) -> Model:
    """A model of the labelled documents of docs; which may be learned from is the caller's choice."""
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter("doc is not null and text is not null and lang is not null")
    # Ids alone are shuffled. About three times the sample passes the hash's cut, however large
    # a language is; then the least hashes stay.
    ids = rows.select("doc", "lang", F.xxhash64("doc").alias("h")).distinct()
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if sizes.limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} different labels")
    part = F.pmod("h", F.lit(1 << 30)).cast("double") / (1 << 30)
    some = ids.join(F.broadcast(sizes), "lang").filter(part * F.col("n") < 3 * per_language)  # max_languages rows at most
    picked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc"))).filter(F.col("r") <= per_language).select("doc", "lang")
    # Broadcast: per_language ids for each language at most. One text for each of them.
    sample = rows.join(F.broadcast(picked), ["doc", "lang"]).groupBy("lang", "doc").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        for b in batches:
            seen = Counter((lang, w) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, Counter] = defaultdict(Counter)
    # Words of a bounded sample of documents.
    for r in sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["word"]] += r["n"]
    pieces = pieces_of(path)
    lattice, langs = Lattice(pieces), sorted(counts)
    p = np.stack([fit_language(lattice, counts[x], rounds) for x in langs]) if langs else np.empty((0, len(pieces)))
    return Model(langs, pieces, p)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary numbers

    def kernel():
        scorer = Scorer(shared.value)
        return lambda texts: list(scorer.predict(texts))

    return per_text(docs, text_col, "lang_pred string, score double", kernel, keep)


def query(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    out = held_out(docs["doc_id"])
    model = fit(docs.filter(~out), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
