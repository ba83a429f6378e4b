"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local
    session (tests) gets a temporary folder, remembered in the session; on a cluster that is an error."""
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key, None) or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder once and read back: lineage ends there, and a lost
    executor costs a re-read, not a re-computation. (checkpoint() would compute df twice.)"""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The folders that materialize() wrote and discard() has not deleted, oldest first.
_written: list[str] = []


def written() -> int:
    """How many folders there are now: what discard() takes as `since`."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Deletes the folders written after the first `since`, except the one that `but` reads.
    Frames that read them can't be used any more."""
    kept = set(but.inputFiles()) if but is not None else set()
    for path in _written[since:]:
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in kept):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _written.remove(path)


def join_first(rows: DataFrame, first: DataFrame, keys: list[str], n: str = "n", most: int = 2000, least: int = 1_000) -> DataFrame:
    """rows joined to `first`, a stored table of one row a key in which `n` is how many rows hold the key. Keys that more than one in
    `most` of the rows hold are fewer than `most`, whatever the data: these are broadcast and their rows
    stay where they are. All other keys are shuffled, so no task gets more than that part of the rows for one key. Keys of up to `least` rows are never hot."""
    total = first.agg(F.sum(n)).first()[0] or 0
    least = max(total // most, least)
    hot = first.filter(F.col(n) > least)
    if not hot.head(1):
        return rows.join(first, keys)
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(first.filter(F.col(n) <= least), keys)
    return rows.join(hot, keys).unionByName(cold)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores put before it until no column of df has it
    (case does not matter, as in Spark's resolution)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: list[str], names: list[str]) -> list[str]:
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that few whole texts are Python objects at a time: `rows` rows, or texts of `size` bytes
    together (or one row, if it is longer)."""
    for batch in batches:
        held = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
                held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(held)
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = min(i + rows, max(i + 1, int(np.searchsorted(ends, before + size, "right"))), batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


class WordHash(dict):
    """Word (bytes or str) -> 64-bit hash, cached. Call trim() between documents: it bounds the memory."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift-multiply; constants of the public splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by keys. Holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        start, rows = 0, list(zip(*cols))
        for i, key in enumerate(rows):
            if last is not None and key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start = [], i
            last = key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def per_text(df: DataFrame, text: str, fields: str, kernel: Callable[[], Callable[[list], list]], keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all by default) with `fields` (a DDL list) computed from the column `text`.
    kernel() is called once a task and gives the function from a list of texts to the arrays of `fields`.
    A kept column that has the name of a field gives way to it."""
    from pyspark.sql import types as T

    made = T._parse_datatype_string(fields).fields
    keep = without(df.columns if keep is None else keep, [f.name for f in made])
    schema = T.StructType(list(df.select(*keep).schema.fields) + list(made))
    src = df.select(*keep, df[text].alias(t := fresh(df, "quarry_text")[0]))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, f = to_arrow_schema(schema), kernel()
        for b in slices(batches):
            made = f(b.column(n).to_pylist())
            arrays = [b.column(i).cast(out.field(i).type) for i in range(n)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, out.field(n + i).type) for i, x in enumerate(made)], schema=out)

    assert src.columns[-1] == t
    return src.mapInArrow(run, schema)
