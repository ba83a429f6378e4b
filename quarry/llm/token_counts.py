"""Token counts of a SentencePiece BPE vocabulary by a two-tier lookup of pre-tokens.

No piece of the vocabulary joins a space (U+2581) to a character before it, and none holds a line
break; this is checked when the vocabulary is loaded. So the library's merges never cross the places before
a run of spaces or around a line break, and a text's count is the sum of the counts of the
pre-tokens between them. The first tier is a compact hash table, broadcast to all workers, of the lengths of
frequent pre-tokens; the second is each worker's cache of what it had to encode.

The table comes from the vocabulary itself, which lists its pieces by how early they were merged, so by how frequent they were:
every piece that starts a word is a frequent pre-token, also with the marks in `tails` after it. It is made once on the
driver, in a second, and its size is bounded by the vocabulary's; no document is read for it and no pre-token is
shuffled or collected. It affects speed alone: what it lacks is encoded.

Defined cases. Null text counts as empty: 0 bytes, 0 tokens. Strings of special tokens inside a text are
ordinary text, as by the library's default. Repeated rows are counted alike; an empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import per_text, read

LIMIT = 4096
TAILS = ("", ",", ".")
CACHE = 300_000

_PRE = re.compile(r"\n| +[^ \n]*|[^ \n]+")


def vocabulary(path: str):
    """The library's processor of the model at path, after a check that pre-tokens are independent."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"{piece!r} crosses pre-tokens: this vocabulary can't be counted by pre-token")
    probe = "a  b\n\nc ▁d"
    if sp.encode(probe + " " + probe) != sp.encode(probe) + sp.encode(probe):
        raise ValueError("this vocabulary's normaliser changes spaces: it can't be counted by pre-token")
    return sp


def pre_tokens(text: str) -> list[str]:
    """The pieces of a text that are encoded apart; the library puts a space before a text."""
    return _PRE.findall(" " + text.replace("▁", " ")) if text else []


class Lengths(dict):
    """Pre-token -> number of tokens: the shared table's entries, then a bounded cache of the rest."""

    def __init__(self, path: str, table: dict[str, int], most: int = CACHE):
        super().__init__(table)
        self.table, self.most, self.sp = table, most + len(table), vocabulary(path)
        self.base = len(self.sp.encode("\n"))

    def __missing__(self, pre: str) -> int:
        # After a line break the library adds no space: the rest is the pre-token's own count.
        n = len(self.sp.encode("\n" + pre)) - self.base
        if len(pre) <= 64:
            self[pre] = n
        return n

    def count(self, text: str | None) -> int:
        n = sum(map(self.__getitem__, pre_tokens(text))) if text else 0
        if len(self) > self.most:
            self.clear()
            self.update(self.table)
        return n


def frequent(path: str, tails: tuple[str, ...] = TAILS) -> dict[str, int]:
    """Lengths of the pre-tokens that the vocabulary's word-initial pieces make."""
    lengths = Lengths(path, {})
    sp = lengths.sp
    words = {p[1:] for p in map(sp.id_to_piece, range(sp.get_piece_size())) if p[0] == "▁" and len(p) > 1}
    made = [f" {w}{t}" for w in sorted(words) for t in tails]
    return {pre: len(ids) - lengths.base for pre, ids in zip(made, sp.encode(["\n" + pre for pre in made]))}


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", limit: int = LIMIT, keep: list[str] | None = None, tails: tuple[str, ...] = TAILS, cache: int = CACHE) -> DataFrame:
    """docs' columns `keep` (all by default) with n_bytes, n_tokens and over_limit (more than `limit` tokens)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(path, tails))

    def kernel():
        lengths = Lengths(path, table.value, cache)

        def run(texts):
            counts = [lengths.count(t) for t in texts]
            return [len(t.encode()) if t else 0 for t in texts], counts, [n > limit for n in counts]

        return run

    return per_text(docs, text_col, "n_bytes long, n_tokens long, over_limit boolean", kernel, keep)


def query(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
