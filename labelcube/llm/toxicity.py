"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, slices
from .learning import SLOTS, sample, sigmoid, word_features

#: Labelled documents the model is fitted on; labels beyond them are not read. What scores a text follows from its words alone.
TRAIN_DOCS = 6000
THRESHOLD = 0.3
#: The fold of crc32(doc_id as text) mod 4 that no label is learned from.
FOLDS, HELD_OUT = 4, 2

_STOPS = np.zeros(256, np.int32)
_STOPS[[10, 33, 46, 63]] = 1  # line end, !, . and ? end a sentence


def sentence_features(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Slots by word, and the sentence each word is in; sentences' rows, first bytes and ends within their rows."""
    row, begin, end, slots, (data, at) = word_features(column, fold=True)
    if not len(row):
        none = np.zeros(0, np.int64)
        return slots, none, none, none, none
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
    ended = stops[begin]
    new = np.concatenate([[True], (ended[1:] != ended[:-1]) | (row[1:] != row[:-1])])
    # A stop within a word, as in 1.5, does not end its sentence for the words before it.
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    return slots, sentence, row[first], begin[first] - at[row[first]], end[last] - at[row[first]]


def noisy_or(logits: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over each row's sentences; 0 for rows without any."""
    return 0.0 - np.expm1(np.bincount(rows, -np.logaddexp(0, logits), n))


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 400, rate: float = 0.3, sparse: float = 0.5, least: float = 12.0) -> tuple[np.ndarray, float]:
    """Weights and shift of sentence logits from (label, slots by word, sentence by word) of documents.

    Features are those in 3 documents or more that toxic ones hold more often than chance has it (a likelihood ratio
    of at least `least`). The loss of a document is the log loss of its noisy-or, lowered by proximal AdaGrad on all
    documents at once: a feature's weight stays 0 until its gradients sum to over `sparse`.
    """
    weights, shift = np.zeros(SLOTS), -6.0
    bags = [b for b in bags if len(b[1])]
    if not bags:
        return weights.astype(np.float32), shift
    y = np.array([b[0] for b in bags], float)
    counts = np.array([int(b[2].max()) + 1 for b in bags])
    base = np.concatenate([[0], np.cumsum(counts)])
    bag_of = np.repeat(np.arange(len(bags)), counts)
    n, k = np.zeros(SLOTS), np.zeros(SLOTS)
    for _, slots, _ in bags:
        own = np.unique(slots)
        n[own] += 1
    for _, slots, _ in (b for b in bags if b[0]):
        k[np.unique(slots)] += 1
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    some = np.maximum(n, 1)
    rate_of = np.clip(k / some, 1e-9, 1 - 1e-9)
    ratio = 2 * (k * np.log(rate_of / share) + (n - k) * np.log((1 - rate_of) / (1 - share)))
    chosen = (n >= 3) & (rate_of > share) & (ratio >= least)
    pairs = []
    for i, (_, slots, sentence) in enumerate(bags):
        word, column = np.nonzero(chosen[slots])
        pairs.append(np.unique(((sentence[word] + base[i]) << 18) | slots[word, column]))
    pairs = np.concatenate(pairs)
    sentence, slots = pairs >> 18, pairs & (SLOTS - 1)
    slots = (np.cumsum(chosen) - 1)[slots]
    own_weights = np.zeros(int(chosen.sum()))
    seen, seen0 = np.full(len(own_weights), 1.0), 1.0
    for _ in range(rounds):
        z = shift + np.bincount(sentence, own_weights[slots], base[-1])
        whole = np.clip(noisy_or(z, bag_of, len(bags)), 1e-9, 1 - 1e-9)
        g = sigmoid(z) * np.where(y > 0, -(1 - whole) / whole, 1.0)[bag_of]
        grad = np.bincount(slots, g[sentence], len(own_weights))
        seen += grad**2
        step = rate / np.sqrt(seen)
        own_weights -= step * grad
        own_weights = np.sign(own_weights) * np.maximum(np.abs(own_weights) - step * sparse, 0)
        seen0 += g.sum() ** 2
        shift -= 0.2 * g.sum() / np.sqrt(seen0)
    weights[chosen] = own_weights
    return weights.astype(np.float32), float(shift)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", label: str = "toxic", most: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Fit on at most `most` labelled documents; their features, not their texts, come to the driver. A document with several labels has the largest."""
    learned = labels.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(sample(learned, most, "id"))
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(chosen, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            slots, sentence, owner, _, _ = sentence_features(batch.column("text"))
            starts = np.searchsorted(owner, np.arange(batch.num_rows))
            words = np.searchsorted(owner[sentence], np.arange(batch.num_rows + 1))
            out = [(slots[a:b].astype("<i4").tobytes(), (sentence[a:b] - starts[i]).astype("<i4").tobytes()) for i, (a, b) in enumerate(zip(words, words[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *(pa.array(c, pa.binary()) for c in zip(*out))], names=["id", "y", "slots", "sentence"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    got = scratch.write(rows.mapInArrow(run, "id long, y int, slots binary, sentence binary"), "features").toLocalIterator()  # a partition at a time
    bags = sorted(((r["id"], r["y"], bytes(r["slots"]), bytes(r["sentence"])) for r in got), key=lambda b: (b[0], b[2]))
    scratch.drop("features", collect=False)
    return fit([(y, np.frombuffer(slots, "<i4").reshape(-1, 4), np.frombuffer(sentence, "<i4")) for _, y, slots, sentence in bags])


def offending(z: np.ndarray, rows: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Sentences over the threshold, and those that carry a row's noisy-or `whole` over it: by row, worst first."""
    order = np.lexsort([-z, rows])
    r, left = rows[order], -np.logaddexp(0, z[order])  # logs of 1 - p
    sums = np.cumsum(left) - left
    first = np.searchsorted(r, r)
    before = -np.expm1(sums - sums[first])  # noisy-or of the row's worse sentences
    return order[(z[order] >= np.log(THRESHOLD / (1 - THRESHOLD))) | ((whole[r] >= THRESHOLD) & (before < THRESHOLD))]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, score, offending (sentences, worst first: first byte, end, probability).

    Offending are all sentences of probability 0.3 or more; and, where the noisy-or over those alone is below 0.3 but the
    document's is not, as many of the next worst as carry it to 0.3.

    An empty or null text has score 0 and no sentences. Other columns are ignored; repeated rows score alike.
    """
    weights, shift = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in slices(batches, "text"):
            slots, sentence, owner, begin, end = sentence_features(batch.column("text"))
            pairs = np.unique((np.repeat(sentence, slots.shape[1]).astype(np.int64) << 18) | slots.ravel())  # a feature counts once a sentence
            z = shift + np.bincount(pairs >> 18, weights[pairs & (SLOTS - 1)], len(owner))
            whole = noisy_or(z, owner, batch.num_rows)
            worst: list[list] = [[] for _ in range(batch.num_rows)]
            for i in offending(z, owner, whole):
                worst[owner[i]].append({"begin": int(begin[i]), "end": int(end[i]), "probability": float(sigmoid(z[i]))})
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(whole), pa.array(worst, kind)], names=["id", "score", "offending"])

    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double, offending array<struct<begin:long,end:long,probability:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % FOLDS
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != HELD_OUT)
    scored = score(docs, train(docs, labels)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
