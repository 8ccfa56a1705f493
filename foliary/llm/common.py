"""Helpers of the corpus operators: row keys, tables in the shared folder, word and shingle hashes, components.

Words are `[^\\x20\\x09-\\x0D]+` of a text whose A-Z are lower-cased; they are hashed to 64 bits in numpy, a slice of
rows at a time, so that no interpreted loop runs over words.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 21
_OWN_FOLDERS: dict[str, str] = {}


# ---------------------------------------------------------------- tables and keys


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; in local mode, where it is unset, one of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[app], True)
    return _OWN_FOLDERS[app]


class Scratch:
    """Intermediate tables of one run: Parquet in the shared folder, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/foliary-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """The rows of `df`, written; in a folder for each value of `by`, if given."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._foliary_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._foliary_path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """A key that is never null and equal only for equal rows (repeated rows share it and get the same result)."""
    return F.xxhash64(*[F.col(c) for c in columns])


def held(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of `docs` as one, `all`, beside `row`, so that no name of theirs can clash with one of ours."""
    return docs.select(F.struct("*").alias("all"), row_key("doc_id", "text").alias("row"), *more)


PLACE_BITS = 33


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """A range sort: `place` grows along the order, by 1 within the rows that one task sorts, in its upper bits the task.

    Write the result before use; a task's rows are bounded as long as few rows tie.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


# ---------------------------------------------------------------- hashing of words

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[1], np.full(max(n, 1024), _PRIME)]).astype(np.uint64))
    return _POWERS


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `limit` bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the offsets of each text's words."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and the offsets of each text's words."""
    data, off = utf8(column)
    starts, ends, word_off = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), word_off
    n = ends - starts
    lead = int(starts[0])
    at = np.arange(lead, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _BYTE[_LOWER[data]]
    value[lead:] *= _powers(int(at.max()) + 1)[at]
    value[_SPACE[data]] = 0
    return mix(np.add.reduceat(value, starts) + n.astype(np.uint64) * _STEP), word_off


def runs_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = mix((h + words[j : j + n]) * _STEP + np.uint64(j + 1))
    return h


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct k-word shingles, one after the other, and the offsets of the texts.

    Fewer words make one shingle, no words none.
    """
    words, off = word_hashes(column)
    count = np.diff(off)
    size = np.where(count >= k, count - k + 1, count > 0)
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint64)
    runs = runs_hash(words, k)
    whole = (np.repeat(off[1:], count) - np.arange(len(words)) >= k)[: len(runs)]
    out[np.repeat(count >= k, size)] = runs[whole]
    for i in np.flatnonzero((count > 0) & (count < k)):
        out[start[i]] = runs_hash(words[off[i] : off[i + 1]], int(count[i]))[0]
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[start[:-1][size > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[start]


# ---------------------------------------------------------------- components


def forest(a: list, b: list) -> dict:
    """The smallest connected value of each end of the edges `a[i], b[i]`."""
    root: dict = {}
    for x, y in zip(a, b, strict=True):
        for v in (x, y):
            root.setdefault(v, v)
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for v in sorted(root):
        root[v] = root[root[v]]
    return root


def components(edges: DataFrame, scratch: Scratch, per_task: int = 500_000) -> DataFrame:
    """`id, component` for every end of an edge (`a`, `b`); component is the smallest id reachable.

    Tasks first reduce the edges they hold to trees of depth one. While more edges are left than one task may hold,
    each vertex joins the neighbour of least priority, a hash of round and id, and the edges are contracted; vertices
    shrink by a constant factor in expectation, whatever the shape. Hot vertices meet only partial aggregates and
    equi joins that the optimizer may split.
    """
    order = lambda c, r: F.struct(F.xxhash64(F.lit(r), c).alias("h"), c.alias("v"))

    def shrink(batches):
        t = [(x, y) for b in batches for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        root = forest(*map(list, zip(*t, strict=True))) if t else {}
        yield pa.record_batch([pa.array(list(x), schema.field(0).type) for x in (root.keys(), root.values())], schema=schema)

    e = edges.where(F.col("a") != F.col("b")).select("a", "b")
    kind = e.dtypes[0][1]
    schema = pa.schema([(x, pa.binary() if kind == "binary" else pa.int64()) for x in "ab"])
    e, steps, n = scratch.table(e, "edges"), [], 0
    while True:
        n = e.count()
        parts = max(1, -(-n // per_task))
        e = scratch.table(e.coalesce(parts).mapInArrow(shrink, f"a {kind}, b {kind}"), "trees")
        if parts == 1:
            break
        r = len(steps)
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        m = both.groupBy("a").agg(F.min(order(F.col("b"), r)).alias("o"))
        m = scratch.table(m.select(F.col("a").alias("id"), F.least(order(F.col("a"), r), "o")["v"].alias("m")), "step")
        one, two = m.select(F.col("id").alias("a"), F.col("m").alias("x")), m.select(F.col("id").alias("b"), F.col("m").alias("y"))
        e = e.join(one, "a").join(two, "b").where(F.col("x") != F.col("y"))
        e = scratch.table(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        steps.append(m)
    last = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if not steps:
        return last
    out = steps[0].select("id", F.col("m").alias("root"))
    for m in [*steps[1:], last.withColumnRenamed("component", "m")]:
        out = out.join(m.select(F.col("id").alias("root"), "m"), "root", "left").select("id", F.coalesce("m", "root").alias("root"))
    out = scratch.table(out, "roots")
    least = out.groupBy("root").agg(F.min("id").alias("component"))
    return scratch.table(out.join(least, "root").select("id", "component"), "components")


# ---------------------------------------------------------------- bounded membership filter


def _slot(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(h.astype(np.uint64)) & np.uint64((1 << bits) - 1)
    return (x >> np.uint64(6)).astype(np.int64), x & np.uint64(63)


def membership(hashes: DataFrame, bits: int = 24) -> np.ndarray:
    """A bitmap of 2**bits bits with those of all values of the one long column set; never larger, whatever the input.

    It only spares rows that cannot match from a shuffle; the exact join follows.
    """

    def mark(batches):
        table = np.zeros(1 << (bits - 6), np.uint64)
        for b in batches:
            word, bit = _slot(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            np.bitwise_or.at(table, word, np.uint64(1) << bit)
        used = np.flatnonzero(table)
        yield pa.record_batch({"word": pa.array(used), "mask": pa.array(table[used].view(np.int64))})

    rows = hashes.mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def possible(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where a hash may be among those marked."""
    word, bit = _slot(h, len(table).bit_length() - 1 + 6)
    return (table[word] >> bit) & np.uint64(1) == 1


def flagged(table: np.ndarray, column: str) -> Column:
    """`possible` of a long column as an expression, so that a row's other columns never leave the JVM."""

    def look(h: pd.Series) -> pd.Series:
        return pd.Series(possible(table, h.to_numpy(np.int64).view(np.uint64)))

    return F.pandas_udf(look, "boolean")(F.col(column))
