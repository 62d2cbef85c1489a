"""SimHash near-deduplication: tiles of fingerprints compared exactly by exclusive or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, documents, fresh, row_key, salted, slices, texts

RADIUS = 3
#: Fingerprints in a block, the unit that is sent around, and in a tile, the unit that is compared or skipped.
BLOCK, TILE = 32768, 256


def fingerprint(text: bytes, width: int = 3, at_once: int = 1 << 16) -> int:
    """Bit i is set if it is in over half of the XXH64 (seed 42) of the word shingles, repeats included; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate((len(w) + 1 for w in words)))
    begins = [0, *ends[: len(words) - width]]
    ends = ends[width - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(begins), at_once):
        h = np.array([digest(joined[a : b - 1], 42) for a, b in zip(begins[i : i + at_once], ends[i : i + at_once])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, mark, fp) of every row; mark is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(t) for t in texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(fp)], names=["id", "mark", "fp"])

    rows = docs.select(F.col(id_).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, mark long, fp long")


class Forest:
    """Links within one array, kept as trees whose roots are the smallest positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        x = self.parent[x]
        while (self.parent[x] != x).any():
            x = self.parent[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def lanes(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the eight bytes: within a radius of bits, these counts differ by no more in all."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)).astype(np.int16)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints linked to each other in left, or across left and right, as (fingerprint, root) without repeats.

    Tiles whose ranges of bit counts lie further apart than the radius are skipped; the others are compared
    pair by pair. A dense group leaves one row a fingerprint, not one a pair.
    """
    every = left if right is None else np.concatenate([left, right])
    forest, start = Forest(len(every)), 0 if right is None else len(left)
    other = left if right is None else right

    def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, cut = lanes(x), np.arange(0, len(x), tile)
        return np.minimum.reduceat(counts, cut), np.maximum.reduceat(counts, cut)

    if not len(left) or not len(other):
        return every[:0], every[:0]
    (low, high), (low2, high2) = boxes(left), boxes(other)
    for i in range(len(low)):
        apart = np.maximum(0, np.maximum(low[i] - high2, low2 - high[i])).sum(axis=1)
        mine = left[i * tile : (i + 1) * tile, None]
        for j in np.flatnonzero(apart <= radius):
            if right is None and j < i:
                continue
            a, b = np.nonzero(np.bitwise_count(mine ^ other[None, j * tile : (j + 1) * tile]) <= radius)
            if right is None and j == i:
                a, b = a[a < b], b[a < b]
            if len(a):
                forest.link(a + i * tile, b + j * tile + start)
    root = forest.root(np.arange(len(every)))
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every[moved], every[root[moved]]


def _order(fp: str):
    """Bit counts of the bytes as one number, to sort by: near fingerprints get near blocks."""
    return sum((F.shiftleft(F.bit_count(F.shiftright(fp, 8 * i).bitwiseAND(F.lit(255))).cast("long"), 28 - 4 * i) for i in range(8)), F.lit(0).cast("long"))


def near_blocks(ranges: DataFrame, radius: int) -> DataFrame:
    """(block, i, j) for each pair i <= j of blocks whose ranges (low, high) of bit counts lie within the radius, once for each of its blocks.

    Blocks meet where the counts of their first two bytes do: one goes by what it holds, the other by what is within the radius of that.
    """
    def spread(name: str, by: int) -> DataFrame:
        cell = lambda k: F.explode(F.sequence(F.greatest(F.col("low")[k] - by, F.lit(0)), F.least(F.col("high")[k] + by, F.lit(8))))
        return ranges.select("*", cell(0).alias("x")).select("*", cell(1).alias("y")).select("x", "y", F.struct("block", "low", "high").alias(name))

    gap = "aggregate(zip_with(zip_with(a.low, b.high, (x, y) -> x - y), zip_with(b.low, a.high, (x, y) -> x - y), (x, y) -> greatest(x, y, 0)), 0, (t, x) -> t + x)"
    near = spread("a", 0).join(spread("b", radius), ["x", "y"]).where("a.block <= b.block").where(F.expr(gap) <= radius)
    pairs = near.select(F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()
    return pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")


def linked(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fps(fp) such that within their closure all links of radius are.

    The fingerprints, sorted by their bytes' bit counts, are cut into blocks of bounded size. Each pair of blocks
    whose ranges of bit counts are near enough is one group of bounded size, compared tile by tile.
    """
    n = fps.count()
    parts = max(1, -(-n // block))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fp = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy(zero_copy_only=False) for b in batches)]).view(np.uint64)
        counts = lanes(fp)
        fp = fp[np.lexsort([fp, *counts.T[::-1]])]
        part = TaskContext.get().partitionId()
        for k, i in enumerate(range(0, len(fp), block)):
            own = fp[i : i + block]
            box = lanes(own)
            yield pa.RecordBatch.from_pydict(
                {"block": [part << 32 | k], "low": [box.min(axis=0).tolist()], "high": [box.max(axis=0).tolist()], "fps": [own.tobytes()]},
                schema=pa.schema([("block", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("fps", pa.binary())]),
            )

    blocks = fps.select("fp", _order("fp").alias("o")).repartitionByRange(parts, "o", "fp").select("fp")
    blocks = scratch.write(blocks.mapInArrow(cut, "block long, low array<int>, high array<int>, fps binary"), "blocks")
    sides = near_blocks(blocks.select("block", "low", "high"), radius)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.frombuffer(x, np.uint64) for x in pdf["fps"]]
        a, b = tile_links(sides[0], sides[1] if len(sides) > 1 else None, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return blocks.select("block", "fps").join(sides, "block").groupBy("i", "j").applyInPandas(compare, "a long, b long")


def _labelled(docs: DataFrame, text: str, id_: str, radius: int) -> DataFrame:
    """(id, mark, fp, lead) for each row of docs: lead is the least of its group by id, nulls last, then by mark."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, text, id_), "fps").withColumn("salt", salted("id"))
    lead = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "mark")).alias("lead")
    dealt = rows.groupBy("fp", "salt").agg(lead)
    nodes = scratch.write(dealt.groupBy("fp").agg(F.min("lead").alias("lead"), F.collect_set("salt").alias("salts")), "nodes")
    edges = scratch.write(linked(nodes.select("fp"), scratch, radius), "edges")
    groups = components(edges, scratch)
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "lead", "salts", F.coalesce("root", "fp").alias("root"))
    named = scratch.write(named, "named")
    smallest = scratch.write(named.groupBy("root").agg(F.min("lead").alias("lead")), "smallest")
    labels = named.drop("lead").join(smallest, "root").select("fp", F.explode("salts").alias("salt"), "lead")
    scratch.drop("blocks", "edges", "nodes", *(name for name in scratch.names() if name.startswith("stars")))
    return rows.join(labels, ["fp", "salt"]).select("id", "mark", "fp", "lead")


def near_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Two documents link when their fingerprints differ in `radius` bits or fewer; texts without words have
    fingerprint zero and link like any other; null text is empty. A row with a null id gets the component_id of its
    group, null if no row there has an id. Repeated rows are returned as often as they come. Other columns
    are ignored. Equal fingerprints are one node, gathered by partial aggregation; labels come back joined by
    fingerprint and salt, so copies in any number stay spread.
    """
    found = _labelled(docs, text, id_, radius)
    return found.select(F.col("id").alias(id_), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("lead.id").alias("component_id"))


def one_per_group(docs: DataFrame, text: str = "text", id_: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Of each group one row of docs, with all its columns: that of the smallest id, or of the least hash of its text where ids are equal or null.

    Of rows that repeat an id and its text, one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    (own,) = fresh(docs, "own")
    stay = _labelled(docs, text, id_, radius).where(F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("mark") == F.col("lead.mark")))
    stay = scratch.write(stay.select(row_key(F.col("id"), F.col("mark")).alias(own)).distinct(), "stay")
    scratch.drop()
    met = docs.withColumn(own, row_key(F.col(id_).cast("long"), F.xxhash64(F.col(text).cast("string")))).join(stay, own, "left_semi")
    return met.dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
