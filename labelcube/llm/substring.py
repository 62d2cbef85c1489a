"""Substring deduplication over a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, mix, slices, span_hashes, texts, utf8, words_of

#: Words of a window, and of the pieces of it of which the one of smallest hash is the window's fingerprint.
WINDOW, PIECE = 35, 8
#: Batches that the query adds one after the other, and runs that are merged into one.
BATCHES, FANOUT = 4, 2
_TEXT = "id long, mark long"


def window_anchors(words: np.ndarray, row: np.ndarray, window: int = WINDOW, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of one row's word hashes: its first word, the first word of its piece of smallest hash, and that hash.

    Equal windows have equal anchors at equal places, the first of equally small ones; neighbours mostly share theirs, so an
    index of anchors holds about one entry in 14 words.
    """
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at = np.arange(len(words) - piece + 1)
    pieces = mix(span_hashes(words, at, at + piece))
    reach, span = at, 1  # reach[i]: the smallest of the span pieces from i
    width = window - piece + 1
    while 2 * span <= width:
        a, b = reach[: len(reach) - span], reach[span:]
        reach, span = np.where(pieces[a] <= pieces[b], a, b), 2 * span
    a, b = reach[:n], reach[width - span :][:n]
    reach = np.where(pieces[a] <= pieces[b], a, b)
    start = np.flatnonzero(row[:n] == row[window - 1 :])
    return start, reach[start], pieces[reach[start]]


def _keyed(docs: DataFrame, text: str, id_: str) -> DataFrame:
    """id, and a mark of id and text that keeps rows apart that share an id."""
    own = docs.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return own.withColumn("mark", F.xxhash64("id", "text"))


def anchors(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(hash, id, mark, at) of each anchor of keyed documents; at counts words in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, ends = utf8(batch.column("text"))
            begin, end, row = words_of(data, ends)
            first = np.searchsorted(row, np.arange(batch.num_rows))
            _, at, h = window_anchors(span_hashes(data, begin, end), row, window, piece)
            new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
            at, h = at[new], h[new]
            of = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("id").take(pa.array(of)), batch.column("mark").take(pa.array(of)), pa.array((at - first[of]).astype(np.int32))], names=["hash", "id", "mark", "at"])

    return docs.select("id", "mark", "text").mapInArrow(run, f"hash long, {_TEXT}, at int")


class FingerprintIndex:
    """Sorted, immutable runs of the anchors of all batches so far, in a folder that a later session can open().

    Each batch becomes a run, which is merge-joined with the runs before it; `fanout` runs of a level are merged
    into one of the next. repeated() has the hashes found more than once so far, occurrences() all their places.
    """

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout, self.made = scratch, fanout, 0
        self.runs: list[tuple[int, str, DataFrame]] = []
        self.found: list[DataFrame] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> FingerprintIndex:
        """The index that lies in a folder; an empty one if there is none."""
        index = cls(Scratch.at(spark, folder), fanout)
        names = index.scratch.names()
        for name in names:
            if m := re.fullmatch(r"run(\d+)-(\d+)|found(\d+)", name):
                index.made = max(index.made, int(m[1] or m[3]))
                table = spark.read.parquet(f"{index.scratch.root}/{name}")
                if m[1]:
                    index.runs.append((int(m[2]), name, table))
                else:
                    index.found.append(table)
        return index

    def _run(self, rows: DataFrame, level: int) -> DataFrame:
        self.made += 1
        name = f"run{self.made}-{level}"
        run = self.scratch.write(rows.sortWithinPartitions("hash"), name)  # sorted files; a frequent hash lies in as many as it comes from
        self.runs.append((level, name, run))
        return run

    @staticmethod
    def _all(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for more in tables[1:]:
            out = out.unionByName(more)
        return out

    def add(self, rows: DataFrame) -> DataFrame:
        """Index a batch of anchors; the hashes that it repeats, from itself or from any run before.

        Both sides of the join are counted or made distinct where they lie first, so a frequent hash is a row a partition.
        """
        before = [run for _, _, run in self.runs]
        run = self._run(rows, 0)
        counted = run.groupBy("hash").agg(F.count("*").alias("n"))
        found = counted.where("n > 1").select("hash")
        if before:
            found = found.unionByName(counted.where("n = 1").select("hash").hint("merge").join(self._all(before).select("hash").distinct(), "hash", "left_semi"))
        self.found.append(self.scratch.write(found, f"found{self.made}"))
        self.compact()
        return self.found[-1]

    def compact(self) -> None:
        while full := next((same for x in sorted({x for x, _, _ in self.runs}) if len(same := [r for r in self.runs if r[0] == x]) >= self.fanout), None):
            self.runs = [r for r in self.runs if r[0] != full[0][0]]
            self._run(self._all([run for _, _, run in full]), full[0][0] + 1)
            self.scratch.drop(*(name for _, name, _ in full), collect=False)

    def repeated(self) -> DataFrame:
        return self._all(self.found).distinct()

    def occurrences(self) -> DataFrame:
        hashes = self.scratch.write(self.repeated(), f"repeated{self.made}")  # a plain side, so that a frequent hash can be split at run time
        return self._all([run for _, _, run in self.runs]).join(hashes, "hash", "left_semi")


def _squeezed(docs: DataFrame) -> DataFrame:
    """(id, mark, body): texts compressed, for what has to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array([press.compress(t) for t in texts(batch.column("text"))], pa.binary())], names=["id", "mark", "body"])

    return docs.select("id", "mark", "text").mapInArrow(run, f"{_TEXT}, body binary")


def _unpressed(bodies: pa.Array) -> list[bytes]:
    one = zstandard.ZstdDecompressor()
    return [one.decompress(b) for b in bodies.to_pylist()]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def removals(docs: DataFrame, text: str = "text", id_: str = "doc_id", window: int = WINDOW, piece: int = PIECE, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one space; null if all are kept).

    A word goes if a window of `window` words around it has the same words as a window that starts elsewhere, in whatever
    document. Anchors that occur once rule out their windows; the others' windows are verified by a digest
    of their text, counted over the corpus, and those found twice mark their words. Null text has no words; a row that is
    repeated, with its id or without, is another place; null ids are carried. Other columns are ignored.

    Texts move compressed, once, and those in question once more. Hashes and digests are counted by partial aggregation
    and looked up by joins whose large side can be split, so a passage that a third of the documents hold stays spread.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    own = _keyed(docs, text, id_)
    index = FingerprintIndex(scratch, fanout)
    for k in range(batches):
        index.add(anchors(own.where(F.pmod(F.col("mark"), F.lit(batches)) == k), window, piece))
    places = scratch.write(index.occurrences().groupBy("id", "mark").agg(F.collect_set("at").alias("places")), "places")
    scratch.drop(*(name for _, name, _ in index.runs))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_words", "kept_sha256", "body", "starts", "digests", "checks"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in slices(batches, "body", 1 << 20):
            out = []
            for id_, body, raw, at in zip(*(batch.column(c).to_pylist() for c in ("id", "body")), _unpressed(batch.column("body")), batch.column("places").to_pylist()):
                words = raw.split()
                if not at:
                    out.append((id_, len(words), _digest(words), None, None, None, None))
                    continue
                joined = b" ".join(words)
                sizes = np.array([len(w) + 1 for w in words], np.int64)
                end = np.cumsum(sizes) - 1
                begin = end + 1 - sizes
                start, anchor, _ = window_anchors(span_hashes(np.frombuffer(joined, np.uint8), begin, end), np.zeros(len(words), np.int64), window, piece)
                start = start[np.isin(anchor, at)]
                told = np.frombuffer(b"".join(hashlib.blake2b(joined[a:b], digest_size=12).digest() for a, b in zip(begin[start].tolist(), end[start + window - 1].tolist())), np.uint8).reshape(-1, 12)
                out.append((id_, len(words), None, body, start, np.ascontiguousarray(told[:, :8]).view(np.int64).ravel(), np.ascontiguousarray(told[:, 8:]).view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    joined = _squeezed(own).alias("o").join(places.alias("p"), F.col("o.id").eqNullSafe(F.col("p.id")) & (F.col("o.mark") == F.col("p.mark")), "left")
    checked = joined.select("o.id", "body", "places").mapInArrow(verify, "id long, n_words long, kept_sha256 string, body binary, starts array<int>, digests array<long>, checks array<int>")
    checked = scratch.write(checked.withColumn("doc", F.monotonically_increasing_id()), "checked")  # numbers that stay, as they are written
    scratch.drop("places")
    windows = checked.where("body is not null").select("doc", F.inline(F.arrays_zip("starts", "digests", "checks"))).withColumnsRenamed({"starts": "start", "digests": "digest", "checks": "check"})
    twice = scratch.write(windows.groupBy("digest", "check").agg(F.count("*").alias("n")).where("n > 1").select("digest", "check"), "twice")
    scratch.drop()
    marked = scratch.write(windows.join(twice, ["digest", "check"], "left_semi").groupBy("doc").agg(F.collect_list("start").alias("starts")), "marked")
    scratch.drop("twice")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 1 << 20):
            out = []
            for raw, starts in zip(_unpressed(batch.column("body")), batch.column("found").to_pylist()):
                words = raw.split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.array(starts or [], np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((int(gone.sum()), _digest(kept), b" ".join(kept) if gone.any() else None))
            n, sha, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    shape = "id long, n_words long, n_removed long, kept_sha256 string, kept string"
    plain = checked.where("body is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    rest = checked.where("body is not null").select("doc", "id", "n_words", "body").join(marked.withColumnRenamed("starts", "found"), "doc", "left")
    rest = rest.select("id", "n_words", "body", "found").mapInArrow(cut, shape)
    return plain.unionByName(rest).withColumnRenamed("id", id_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, unnest(list_transform(range(1, len(w) - 33), lambda i: sha256(array_to_string(w[i : i + 34], ' ')))) AS k FROM d WHERE len(w) >= 35),
r AS (SELECT doc_id, s FROM p QUALIFY count(*) OVER (PARTITION BY k) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM r),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, i) GROUP BY u.doc_id)
SELECT d.doc_id, len(w) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
