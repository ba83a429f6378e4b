"""N-gram Jaccard join by the chosen-path method.

A document is the set of its `width`-word shingles (words: runs without ASCII white space;
a text of fewer words is one shingle). Documents with equal sets form a class of copies
and are represented by one. Representatives are split recursively:

* In each run a representative chooses about `fan` of its shingles by a hash that all
  representatives share, so similar sets choose the same ones; each (run, shingle) is a bucket.
* Buckets of one go no further. Buckets above `bucket` are split again: by tokens of the set that a
  128-part one-permutation sketch keeps (the least of each part), about `deep_fan` of them, up to `depth` times.
  A bucket of unlike documents that share a few hot shingles falls apart; a bucket whose rows
  are alike on average is a group of near copies and is compared as it is.
* Buckets are compared by brute force, in blocks of `bucket` rows or `tokens` shingles when larger, so no
  task holds an unbounded group. Sketches first name candidates; then the
  whole sets of just those documents are compared exactly. A pair counts in
  the least bucket that both share, so once.
* Runs are repeated until the target `recall`: their number follows from it. A pair at the threshold t meets in a
  run through a branching process: it shares fan * t first paths on average, and each of these
  shares deep_fan * t children at each split. missed() gives the probability that all die out where every bucket is split
  `depth` times, the worst case; the number of runs is the least that brings it to 1 - recall. At the defaults that is 8 runs and a miss of
  2.3e-4 where all is split, 3e-6 where no bucket is. deep_fan * t lies well above 1 (1.6), so
  paths do not die out with depth.

Pairs never leave a task as rows:
a task gives each document's number of partners and a spanning forest of its pairs. The classes are the
connected components of those forests.

Defined cases. Null or empty texts and texts without a word have an empty set: each is a class of its own,
with no links and no copies. Null ids: such a document is compared like others, but rows that share an id
(or null) and a set are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHash, fresh, grouped, join_first, materialize, mix, read, slices
from .components import components

WIDTH = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9995
FAN = 2.0
DEEP_FAN = 2.0
DEPTH = 5
BUCKET = 512
#: Shingles of a block, 32 MB of them; a set that is larger is a block of its own size.
TOKENS = 1 << 22
PARTS = 128
#: Mean likeness from which a large bucket counts as a group of near copies: half the threshold.
DENSE = 0.4
#: Sketches name candidates from this similarity on; at 0.8 an estimate is this low once in 10^6.
SLACK = 0.22

_STEP = U64(0x9E3779B97F4A7C15)
_BOUNDS = np.arange(PARTS, dtype=U64) << U64(57)


def shingles(text: str | None, hashes: WordHash, width: int = WIDTH) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a whole text."""
    h = hashes.of(text.encode().split()) if text else np.empty(0, U64)
    hashes.trim()
    n = len(h)
    if not n:
        return h
    span = min(width, n)
    acc = np.full(n - span + 1, U64(span))
    for k in range(span):
        acc = mix(acc * _STEP + h[k : n - span + 1 + k])
    return np.unique(acc)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a shingle set, as two signed 64-bit numbers."""
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """uint16 for each of PARTS ranges of the hash space: of its least token, 0 if there is none."""
    at = np.searchsorted(tokens, _BOUNDS)
    out = np.zeros(PARTS, np.uint16)
    if not len(tokens):
        return out
    least = tokens[np.minimum(at, len(tokens) - 1)]
    there = (at < len(tokens)) & ((least >> U64(57)) == np.arange(PARTS, dtype=U64))
    out[there] = ((least[there] >> U64(8)) % U64(65535)).astype(np.uint16) + 1
    return out


def chosen(tokens: np.ndarray, path: int, fan: float) -> np.ndarray:
    """The child paths of `path` that a set of these tokens takes: about `fan`."""
    if not len(tokens):
        return tokens
    g = mix(tokens ^ mix(np.array([path], U64)))
    most = min(int(fan / len(tokens) * 2.0**64), 2**64 - 1)
    return mix(g[g <= U64(most)] + U64(path))


def missed(threshold: float, fan: float, deep_fan: float, depth: int) -> float:
    """The probability that one run does not bring a pair at the threshold together, if its buckets are split `depth` times."""
    gone = 0.0
    for _ in range(depth):
        gone = math.exp(-deep_fan * threshold * (1 - gone))
    return math.exp(-fan * threshold * (1 - gone))


def runs_for(recall: float, threshold: float, fan: float, deep_fan: float, depth: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed(threshold, fan, deep_fan, depth))))


def _first(width: int, runs: int, fan: float):
    seeds = [xxhash.xxh64_intdigest(b"run", seed=r) for r in range(runs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = shingles(text, hashes, width)
                keys = np.concatenate([chosen(t, s, fan) for s in seeds]) if len(t) else t
                rows.append((doc, *digest(t), len(t), keys.view(np.int64), sketch(t).tobytes()))
            if rows:
                cols = list(zip(*rows))
                types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc", "hi", "lo", "size", "keys", "sk"])

    return run


def _deeper(fan: float):
    """(key, node, size, sk) -> (key, node, size) of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at_row = [], []
            for i, (key, sk) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                s = np.frombuffer(sk, np.uint16).astype(U64)
                (at,) = np.nonzero(s)
                found = chosen((at.astype(U64) << U64(32)) | s[at], key & (2**64 - 1), fan).view(np.int64).tolist()
                keys += found
                at_row += [i] * len(found)
            at_row = pa.array(at_row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(1).take(at_row), b.column(2).take(at_row)], ["key", "node", "size"])

    return run


_GROUP = ["leaf", "one", "two"]


def _pairs_of(close: np.ndarray, block: np.ndarray, leaves: list, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs a < b of close that this group decides: of different blocks if it has two, and of this leaf."""
    a, b = np.nonzero(np.triu(close, 1))
    if len(set(block.tolist())) == 2:
        cross = block[a] != block[b]
        a, b = a[cross], b[cross]
    if len(a):
        sets = {i: frozenset(leaves[i]) for i in set(a.tolist()) | set(b.tolist())}
        mine = np.fromiter((min(sets[i] & sets[j]) == leaf for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
        a, b = a[mine], b[mine]
    return a, b


def _estimates(sk: np.ndarray) -> np.ndarray:
    """Estimated similarities of all pairs of rows."""
    n = len(sk)
    out = np.empty((n, n), np.float32)
    full = sk != 0
    for i in range(n):
        same = ((sk == sk[i]) & full).sum(1)
        some = (full | full[i]).sum(1)
        out[i] = same / np.maximum(some, 1)
    return out


def _candidates(threshold: Fraction, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], [], []]
        for g in grouped(batches, _GROUP):
            if g.num_rows > 1:
                node, block, leaves = g["node"].to_pylist(), np.array(g["block"]), g["leaves"].to_pylist()
                sk = np.frombuffer(b"".join(g["sk"].to_pylist()), np.uint16).reshape(-1, PARTS)
                leaf, one, two = (g[k][0].as_py() for k in _GROUP)
                a, b = _pairs_of(_estimates(sk) >= float(threshold) - slack, block, leaves, leaf)
                for i in np.union1d(a, b).tolist():
                    for col, v in zip(out, (leaf, one, two, node[i], int(block[i]), leaves[i])):
                        col.append(v)
            if len(out[0]) > 2000:
                yield _batch(out, _CANDIDATE)
                out = [[], [], [], [], [], []]
        yield _batch(out, _CANDIDATE)

    return run


_CANDIDATE = pa.schema([("leaf", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("node", pa.int64()), ("block", pa.int32()), ("leaves", pa.list_(pa.int64()))])
_LINK = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _batch(cols: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (each sorted, without repeats): products of
    blocks of the incidence matrix of the tokens that two sets have at least."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[col] > 1
    row, col = row[keep], col[keep]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((n, n), np.float32)
    if len(col):
        col = np.cumsum(np.r_[0, col[1:] != col[:-1]])
        for lo in range(0, int(col[-1]) + 1, 4096):
            i, j = np.searchsorted(col, [lo, lo + 4096])
            x = np.zeros((n, 4096), np.float32)
            x[row[i:j], col[i:j] - lo] = 1
            total += x @ x.T
    return total.astype(np.int64)


def _links(threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for g in grouped(batches, _GROUP):
            n = g.num_rows
            if n > 1:
                node, block, leaves = g["node"].to_pylist(), np.array(g["block"]), g["leaves"].to_pylist()
                sets = [np.frombuffer(x, U64) for x in g["tokens"].to_pylist()]
                size = np.array([len(s) for s in sets])
                inter = common_counts(sets)
                union = size[:, None] + size[None, :] - inter
                a, b = _pairs_of(inter * threshold.denominator >= union * threshold.numerator, block, leaves, g["leaf"][0].as_py())
                if len(a):
                    count = np.bincount(np.r_[a, b], minlength=n)
                    root = list(range(n))

                    def top(i: int) -> int:
                        while root[i] != i:
                            root[i] = root[root[i]]
                            i = root[i]
                        return i

                    for i, j in zip(a.tolist(), b.tolist()):
                        i, j = top(i), top(j)
                        if i != j:
                            root[max(i, j)] = min(i, j)
                    for i in np.nonzero(count)[0].tolist():
                        for c, v in zip(out, (node[i], int(count[i]), node[top(i)])):
                            c.append(v)
            if len(out[0]) > 5000:
                yield _batch(out, _LINK)
                out = [[], [], []]
        yield _batch(out, _LINK)

    return run


def _token_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in slices(batches):
            made = [shingles(t, hashes, width) for t in b.column(1).to_pylist()]
            both = [digest(t) for t in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64()), pa.array([t.tobytes() for t in made], pa.binary())], ["node", "hi", "lo", "tokens"])

    return run


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: Fraction = THRESHOLD, recall: float = RECALL, fan: float = FAN, deep_fan: float = DEEP_FAN, depth: int = DEPTH, bucket: int = BUCKET, tokens: int = TOKENS, dense: float = DENSE, slack: float = SLACK) -> DataFrame:
    """A row for each distinct (id, shingle set) of docs: doc (the id), node (a hash of the set), size (of the set),
    class (the least id of its class), n_links (other sets at `threshold` or more), n_copies (other rows of
    the same set)."""
    src = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    kind = src.schema["doc"].dataType.simpleString()
    runs = runs_for(recall, float(threshold), fan, deep_fan, depth)
    every = materialize(src.mapInArrow(_first(width, runs, fan), f"doc {kind}, hi long, lo long, size int, keys array<long>, sk binary"))
    some = every.filter("size > 0")
    node = F.xxhash64("hi", "lo")

    # A representative for each set.
    classes = some.groupBy("hi", "lo").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("members")).select("rep", node.alias("node"), "members")
    whole = some.select("doc", "size", "keys", "sk", node.alias("of")).join(classes, (F.col("of") == F.col("node")) & F.col("doc").eqNullSafe(F.col("rep")))
    reps = materialize(whole.select("node", "rep", "size", "keys", "sk").dropDuplicates(["node"]))

    leaves = _leaves(reps, depth, bucket, deep_fan, dense)
    rows = leaves.groupBy("node").agg(F.collect_list(F.struct(F.col("key").alias("leaf"), "n", "held")).alias("all")).join(reps.select("node", "sk"), "node")
    rows = rows.select("node", "sk", F.col("all.leaf").alias("leaves"), F.explode("all").alias("x"))
    rows = rows.select("node", "sk", "leaves", F.col("x.leaf").alias("leaf"), F.ceil(F.greatest(F.col("x.n") / bucket, F.col("x.held") / tokens)).cast("int").alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("leaf", "node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "block", "leaves", "sk")
    found = materialize(_by_group(rows).mapInArrow(_candidates(threshold, slack), "leaf long, one int, two int, node long, block int, leaves array<long>"))

    # The whole texts of the candidates alone; a representative's id may also have rows of other sets.
    wanted = found.select("node").distinct().join(reps.select("node", "rep"), "node")
    texts = src.join(wanted, src["doc"].eqNullSafe(F.col("rep"))).select("node", "text")
    sets = texts.mapInArrow(_token_sets(width), "node long, hi long, lo long, tokens binary").filter(node == F.col("node")).select("node", "tokens").dropDuplicates(["node"])
    linked = materialize(_by_group(found.join(sets, "node")).mapInArrow(_links(threshold), "node long, links long, root long"))

    # The classes: components, named by their least id.
    roots = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    member = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = member.groupBy("root").agg(F.min("rep").alias("class"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    table = member.join(named, "root").join(links, "node", "left").select("node", "class", F.coalesce("links", F.lit(0)).alias("links"), (F.col("members") - 1).alias("copies"))
    out = every.select("doc", "size", node.alias("node")).distinct().join(table, "node", "left")
    none = F.col("size") == 0
    return out.select("doc", "node", "size", F.when(none, F.col("doc")).otherwise(F.col("class")).alias("class"), F.when(none, 0).otherwise(F.col("links")).cast("long").alias("n_links"), F.when(none, 0).otherwise(F.col("copies")).cast("long").alias("n_copies"))


def _by_group(df: DataFrame) -> DataFrame:
    return df.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sk, pivot) -> (key, like): the estimated similarity of the two sketches."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, PARTS) for i in (1, 2))
            like = ((x == y) & (x != 0)).sum(1) / np.maximum(((x != 0) | (y != 0)).sum(1), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(like)], ["key", "like"])


def _leaves(reps: DataFrame, depth: int, bucket: int, deep_fan: float, dense: float) -> DataFrame:
    """(key, node, n, held): the buckets of two or more that are compared, with their numbers of sets and of shingles. A large bucket whose
    rows are on average `dense` like one of them, chosen by hash, is a group of near copies: splitting it
    further would only repeat it, so it is compared as it is."""
    now, leaves = reps.select("node", "size", F.explode("keys").alias("key")), None
    for level in range(depth + 1):
        counts = materialize(now.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held")).filter("n > 1"))
        counted = materialize(join_first(now, counts, ["key"]).select("key", "node", "size", "n", "held"))
        done = (counted if level == depth else counted.filter(F.col("n") <= bucket)).select("key", "node", "n", "held")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = counted.filter(F.col("n") > bucket)
        if level == depth or not large.head(1):
            break
        wide = materialize(large.join(reps.select("node", "sk"), "node").select("key", "node", "size", "n", "held", "sk"))
        pivot = materialize(wide.groupBy("key").agg(F.min_by("sk", F.xxhash64("key", "node")).alias("pivot"), F.count(F.lit(1)).alias("n")))
        like = join_first(wide.select("key", "sk"), pivot, ["key"]).select("key", "sk", "pivot").mapInArrow(_likeness, "key long, like double")
        like = materialize(like.groupBy("key").agg(F.avg("like").alias("like"), F.count(F.lit(1)).alias("n")))
        known = materialize(join_first(wide.drop("n"), like, ["key"]))
        leaves = leaves.unionByName(known.filter(F.col("like") >= dense).select("key", "node", "n", "held"))
        now = materialize(known.filter(F.col("like") < dense).select("key", "node", "size", "sk").mapInArrow(_deeper(deep_fan), "key long, node long, size int").distinct())
    return leaves


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs whose document has the least id of its class, with docs' own columns; rows with a null id stay
    only if all of their class have none. Rows that repeat an id and a text stay or go together."""
    found = similar(docs, id_col=id_col, text_col=text_col, **params)
    (d,) = fresh(docs, "quarry_doc")
    gone = found.filter("size > 0 and not (doc <=> class)").select(F.col("doc").alias(d)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(F.col(d)), "left_anti")


def query(spark, sf_dir) -> DataFrame:
    found = similar(read(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("class").alias("class_id"), "n_links", "n_copies")
