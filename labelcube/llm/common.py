"""What the operators of this subpackage share: scratch tables, vectorised words, skew-safe lookups, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key are dealt over this many salts wherever rows are gathered by a key.
SALTS = 16
#: Text handled at once by the vectorised code, which needs about 60 bytes of memory a byte of text.
SLICE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one of our own if there is only this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="labelcube-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    A table that the returned DataFrame reads lives as long as the folder, or until clear() once that has been written; the others go with drop().
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/labelcube-{label}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> Scratch:
        """A folder of one's own, such as one that an earlier run has left."""
        own = cls.__new__(cls)
        own.spark, own.root = spark, root.rstrip("/")
        return own

    def names(self) -> list[str]:
        """The tables in the folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    @classmethod
    def clear(cls, since: int) -> None:
        """Delete the folders made since so many of them were; for when nothing reads them any longer."""
        while len(cls.made) > since:
            own = cls.made.pop()
            own.drop("", collect=False)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, collect: bool = True) -> None:
        """Delete tables, and, unless told not to, let go of the shuffle files of plans that are written out."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        for pause in (0.3, 0.1) if collect else ():  # plans are found unused in a first collection, and their shuffles in a second
            gc.collect()
            jvm.System.gc()
            time.sleep(pause)
        if collect:
            release()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_, digest):
    """One string for an id, null or not, and a digest: rows that share it are equal in both."""
    return F.concat(digest.cast("string"), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("null")))


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks, next to others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column holds about `most` bytes at once; one longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            upto = max(at + 1, upto)
            yield batch.slice(at, upto - at)
            release()
            at = upto


def texts(column: pa.Array) -> list[bytes]:
    """The values as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and the last ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word [^\\x20\\x09-\\x0D]+ in the bytes, and the row it belongs to."""
    inside = ~_SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[begin:end] for each span; equal spans have equal hashes."""
    values = values.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    return mix((sums[end] - sums[begin]) * powers(_INVERSE, len(values) + 1)[begin] + (end - begin).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def salted(column, salts: int = SALTS):
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b) of longs, by alternating large and small stars: (node, root), root the smallest.

    Every step is an aggregation and a join by node; the minima are written first, so that a node with many
    edges stands on one side of a plain join and can be split at run time. No component meets in one task.
    """
    stars = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars0")
    before, step = None, 0
    while True:
        found = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if found["n"] == 0 or before == (found["n"], found["s"]):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, step = (found["n"], found["s"]), step + 1
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"least{step}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = scratch.write(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"large{step}")
        least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), f"small{step}")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        stars = scratch.write(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"stars{step}")
        scratch.drop(f"stars{step - 1}", f"least{step}", f"large{step}", f"small{step}")
