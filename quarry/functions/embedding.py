"""Embedding providers: anything that takes a list of texts and gives (index, vector) pairs, in any order. Calls are batched and retried;
on a cluster each task calls the provider for its own rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import truncate_input

Provider = Callable[[list[str]], list[tuple[int, list[float]]]]

# Tries, seconds, and the bounds of a batch and of one input.
TRIES, FIRST_WAIT, LONGEST_WAIT, JITTER = 10, 1.0, 60.0, 0.25
BATCH_TOKENS, BATCH_ROWS, INPUT_TOKENS = 250_000, 1000, 8191


class Busy(Exception):
    """A provider's failure that may pass: too many requests, a server's error, the network."""


def backoff(attempt: int, draw: Callable[[], float] = random.random) -> float:
    """Seconds to wait after the attempt of that number (from 0): doubled each time up to a bound, with jitter."""
    return min(FIRST_WAIT * 2**attempt, LONGEST_WAIT) * (1 - JITTER + 2 * JITTER * draw())


def embed(provider: Provider, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """The vectors of texts, in their order. Busy is retried; any other error, and the last Busy, is raised."""
    if not texts:
        return []
    for attempt in range(TRIES):
        try:
            found = dict(provider(texts))
            break
        except Busy:
            if attempt + 1 == TRIES:
                raise
            sleep(backoff(attempt))
    missing = [i for i in range(len(texts)) if i not in found]
    if missing:
        raise ValueError(f"the provider gave no vector for {len(missing)} of {len(texts)} texts")
    return [[float(x) for x in found[i]] for i in range(len(texts))]


def embed_one(provider: Provider, text: str) -> list[float]:
    return embed(provider, [text])[0]


def batches(texts: list[str], count: Callable[[str], int], tokens: int = BATCH_TOKENS, rows: int = BATCH_ROWS) -> Iterator[list[int]]:
    """Indices in groups of up to `rows` texts and `tokens` tokens; a longer text is a group of its own."""
    now: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        n = count(t)
        if now and (held + n > tokens or len(now) == rows):
            yield now
            now, held = [], 0
        now.append(i)
        held += n
    if now:
        yield now


def byte_codec(per: int = 4) -> tuple[Callable[[str], list], Callable[[list], str]]:
    """Encoder and decoder of tokens of `per` bytes, where no vocabulary is at hand."""

    def encode(text: str) -> list[bytes]:
        b = text.encode()
        return [b[i : i + per] for i in range(0, len(b), per)]

    return encode, lambda tokens: b"".join(tokens).decode("utf-8", "ignore")


def embed_nodes(nodes: DataFrame, provider: Provider, *, codec=None, limit: int = INPUT_TOKENS, column: str = "embedding") -> DataFrame:
    """nodes (with any of signature, docstring, source_code) with `column`, the vector of their text cut to `limit` tokens: the source is cut
    first. Rows that have a vector in `column` already keep it and are not sent; nodes without any text get null."""
    encode, decode = codec or byte_codec()
    src = nodes if column in nodes.columns else nodes.selectExpr("*", f"cast(null as array<float>) as {column}")
    schema = src.schema
    at = {c: src.columns.index(c) for c in ("signature", "docstring", "source_code", column) if c in src.columns}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            have = b.column(at[column]).to_pylist()
            parts = zip(*(b.column(at[c]).to_pylist() if c in at else [""] * b.num_rows for c in ("signature", "docstring", "source_code")))
            todo, texts = [], []
            for i, (sig, doc, source) in enumerate(parts):
                if have[i] is None:
                    text = truncate_input(sig or "", doc or "", source or "", encode, decode, limit)[0]
                    if text:
                        todo.append(i)
                        texts.append(text)
            for group in batches(texts, lambda t: len(encode(t))):
                for i, v in zip(group, embed(provider, [texts[i] for i in group])):
                    have[todo[i]] = v
            cols = list(b.columns)
            cols[at[column]] = pa.array(have, b.schema.field(at[column]).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return src.mapInArrow(run, schema)


class Hashed:
    """A provider that needs no network: signed feature hashing of words, normalised. The same text gives the same vector everywhere."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        out = []
        for i, t in enumerate(texts):
            v = [0.0] * self.dims
            for w in re.findall(r"\w+", t.lower()):
                d = hashlib.sha256(w.encode()).digest()
                v[int.from_bytes(d[:4], "little") % self.dims] += 1 if d[4] & 1 else -1
            size = sum(x * x for x in v) ** 0.5
            out.append((i, [x / size for x in v] if size else v))
        return out
