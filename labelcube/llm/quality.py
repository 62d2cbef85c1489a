"""Quality classifier by co-training: a text view and a metadata view teach each other, then are combined."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, release, slices
from .learning import SLOTS, platt, sample, sigmoid, word_features
from .pitman_yor import pack_keys, planes, squeeze, unpack_keys, unplanes, unsqueeze

#: Labelled documents that the two views are fitted on; all others teach by pseudo-labels, and every document is scored.
TRAIN_DOCS = 6000
#: Rounds of pseudo-labels, the share of all unlabelled documents that each view labels more in a round, and the confidence it takes.
ROUNDS, SHARE, CONFIDENT = 3, 0.1, 0.95
#: Steps over all pseudo-labelled documents in a round, for the text and for the metadata view.
STEPS, NEWTON = 5, 4
#: Bins of a view's calibrated logits, as wide as a hundredth of the confidence's logit; the last holds all beyond.
BINS, _BIN = 2000, float(np.log(CONFIDENT / (1 - CONFIDENT))) / 100
#: Sums that one row carries to where they are added up.
CHUNK = 1 << 13
#: Features, and documents, that a model's sums handle at once, so that they need some MB however many there are.
PIECE, DOCS = 1 << 18, 1 << 10
KEEP = 0.5
#: One-hot slots for the values of lang and of source, by hash.
BUCKETS = 64

_KIND = np.zeros(256, np.int64)  # 1 capital, 2 small, 3 digit, 4 mark, 5 white space, 6 line end, 0 other
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 5, 6
LAYOUT = 13


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, slot and share of each feature of a text: words, their beginnings and ends, and whether a word repeats the one before."""
    row, _, _, slots, _ = word_features(column, fold=False)
    count = np.bincount(row, minlength=len(column))
    same = np.concatenate([[False], (slots[1:, 0] == slots[:-1, 0]) & (row[1:] == row[:-1])]) if len(row) else np.zeros(0, bool)
    slots = np.concatenate([slots, np.where(same, 0, 1)[:, None]], axis=1).astype(np.int64)
    return np.repeat(row, 5), slots.ravel(), np.repeat(1 / np.maximum(count, 1)[row], 5)


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    """A page's facts, without its words: size, layout shares, and hashed language and source. One row per row.

    documents has no more page metadata than lang, source and n_chars, so the layout (lines, shares of kinds of characters) is taken from the text.
    """
    from .common import utf8

    data, at = utf8(batch.column("text"))
    n = batch.num_rows
    row = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(row * 7 + _KIND[data], minlength=7 * n).reshape(n, 7)
    size = np.maximum(np.diff(at), 1)
    stated = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float)
    stated = np.where(np.isfinite(stated), stated, np.diff(at))
    twice = np.bincount(row[1:], (data[1:] == data[:-1]) & (row[1:] == row[:-1]) & (_KIND[data[1:]] == 4), n) if len(row) > 1 else np.zeros(n)
    lines = kinds[:, 6] + 1
    bars = np.bincount(row, data == 124, n)
    dense = [np.log1p(stated) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10, *(kinds[:, k] / size for k in (1, 2, 3, 4, 5)), twice / size, bars / size,
             kinds[:, 4] / np.maximum(kinds[:, 5], 1), kinds[:, 1] / np.maximum(kinds[:, 2] + kinds[:, 1], 1), np.minimum(kinds[:, 0] / size, 1)]
    out = np.zeros((n, LAYOUT + 2 * BUCKETS), np.float32)
    out[:, :LAYOUT] = np.stack(dense, axis=1)
    for k, c in enumerate(("lang", "source")):
        slot = batch.column(c).to_numpy(zero_copy_only=False).astype(int)
        out[np.arange(n), LAYOUT + k * BUCKETS + slot] = 0.2
    return out


def _columns(docs: DataFrame, text: str, id_: str) -> DataFrame:
    has = {c.lower() for c in docs.columns}
    slot = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(BUCKETS)).cast("int") if c in has else F.lit(0)
    long = F.col("n_chars").cast("double") if "n_chars" in has else F.lit(None).cast("double")
    return docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"), slot("lang").alias("lang"), slot("source").alias("source"), long.alias("n_chars"))


def _weights(y: np.ndarray, more: np.ndarray = np.zeros(2)) -> np.ndarray:
    """A weight for label 0 and one for 1, such that both kinds count alike; more: how many of each kind there are elsewhere."""
    return 0.5 / np.maximum(np.array([(y == 0).sum(), (y == 1).sum()]) + more, 1)


class TextModel:
    def fit(self, rows: list, y: np.ndarray, rounds: int = 80) -> TextModel:
        self.w, self.b = np.zeros(SLOTS), 0.0
        self.seen, self.seen0 = np.full(SLOTS, 1e-8), 1e-8
        parts, weigh = flat(rows), _weights(y)
        for _ in range(rounds):
            self.step(*self.gradient(*parts, len(rows), y, weigh[y.astype(int)]))
        return self

    def gradient(self, row: np.ndarray, slot: np.ndarray, share: np.ndarray, n: int, y: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, float]:
        g = (sigmoid(self.logits(row, slot, share, n)) - y) * weigh
        grad = np.zeros(SLOTS)
        for i in range(0, len(row), PIECE):
            grad += np.bincount(slot[i : i + PIECE], g[row[i : i + PIECE]] * share[i : i + PIECE], SLOTS)
        return grad, float(g.sum())

    def step(self, grad: np.ndarray, g0: float) -> None:
        grad = grad + 1e-6 * self.w
        self.seen, self.seen0 = self.seen + grad**2, self.seen0 + g0**2
        self.w, self.b = self.w - 2.0 * grad / np.sqrt(self.seen), self.b - 0.1 * g0 / np.sqrt(self.seen0)

    def logits(self, row: np.ndarray, slot: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, float(self.b))
        for i in range(0, len(row), PIECE):
            z += np.bincount(row[i : i + PIECE], self.w[slot[i : i + PIECE]] * share[i : i + PIECE], n)
        return z

    def of(self, rows: list) -> np.ndarray:
        return np.array([self.b + float((self.w[s] * x).sum()) for s, x in rows])

    def frozen(self) -> TextModel:
        """What scores a text, without the state of the fit."""
        out = TextModel()
        out.w, out.b = self.w.astype(np.float32), self.b
        return out


def flat(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])


class MetadataModel:
    """Logistic regression on standardised facts and the products of the layout facts."""

    @staticmethod
    def spread(x: np.ndarray) -> np.ndarray:
        a = x[:, :LAYOUT].astype(float)
        i, j = np.triu_indices(LAYOUT)
        return np.concatenate([x, a[:, i] * a[:, j], np.sqrt(np.abs(a))], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> MetadataModel:
        spread, weigh = self.spread(x), _weights(y)
        self.mean, self.scale = spread.mean(axis=0), spread.std(axis=0) + 0.05
        self.w = np.zeros(spread.shape[1] + 1)
        del spread
        for _ in range(12):  # Newton's method
            self.step(*self.sums(x, y, weigh[y.astype(int)]))
        return self

    def sums(self, x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The second and the first derivatives of the loss."""
        h, g = np.zeros((len(self.w), len(self.w))), np.zeros(len(self.w))
        for i in range(0, len(x), DOCS):
            at = slice(i, i + DOCS)
            own = np.concatenate([(self.spread(x[at]) - self.mean) / self.scale, np.ones((len(x[at]), 1))], axis=1)
            p = sigmoid(own @ self.w)
            h += (own * (weigh[at] * (p * (1 - p) + 1e-6))[:, None]).T @ own
            g += own.T @ (weigh[at] * (p - y[at]))
        return h, g

    def step(self, h: np.ndarray, g: np.ndarray) -> None:
        self.w = self.w - np.linalg.solve(h + 1e-3 * np.eye(len(g)), g + 1e-3 * self.w)

    def of(self, x: np.ndarray) -> np.ndarray:
        return ((self.spread(x) - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


def _bits(n: int) -> int:
    """Of a key's bits, those that hold the row out of n; the slot's are above, so that a slot's rows follow each other, which packs well."""
    return max(n - 1, 0).bit_length()


def feature_blocks(docs: DataFrame, apart: np.ndarray, text: str, id_: str) -> DataFrame:
    """(n, keys, counts, sizes, facts): both views of the documents whose ids aren't among the sorted `apart`, a row for some MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(~np.isin(ids, apart)))
            if not batch.num_rows:
                continue
            row, slot, _ = text_view(batch.column("text"))
            keys, counts = np.unique(slot << _bits(batch.num_rows) | row, return_counts=True)
            row = {"n": [len(keys)], "keys": [squeeze(np.frombuffer(pack_keys(keys.astype(np.uint64)), np.uint8))], "counts": [planes(counts)],
                   "sizes": [squeeze(np.bincount(row, minlength=batch.num_rows).astype(np.int32))], "facts": [squeeze(metadata_view(batch))]}
            yield pa.RecordBatch.from_arrays([pa.array(row["n"], pa.int64()), *(pa.array(row[c], pa.binary()) for c in list(row)[1:])], names=list(row))

    return _columns(docs, text, id_).where("id is not null").mapInArrow(run, "n long, keys binary, counts binary, sizes binary, facts binary")


_CHOSEN = "n long, keys binary, counts binary, sizes binary, facts binary, labels binary"


def _unpacked(r: dict) -> tuple[np.ndarray, ...]:
    """row, slot, share, facts of a block's documents; and the labels that they got, if they were chosen."""
    keys = unpack_keys(unsqueeze(r["keys"], np.uint8).tobytes(), r["n"]).astype(np.int64)
    sizes = unsqueeze(r["sizes"], np.int32)
    row = keys & ((1 << _bits(len(sizes))) - 1)
    labels = [unsqueeze(r["labels"], np.int8).reshape(2, -1)] if "labels" in r else []
    return row, keys >> _bits(len(sizes)), 5 * unplanes(r["counts"]) / np.maximum(sizes, 1)[row], unsqueeze(r["facts"], np.float32).reshape(len(sizes), -1), *labels


def summed(blocks: DataFrame, make: Callable, scratch: Scratch) -> np.ndarray:
    """The sum over all blocks of the vectors that make(row, slot, share, facts, labels if any) gives, added up in chunks by partition; the driver gets the sum alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                own = make(*_unpacked(batch.slice(k, 1).to_pylist()[0]))
                total = own if total is None else total + own
                del own
                release()
        if total is not None:
            at = range(0, len(total), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(at), pa.int64()), pa.array([squeeze(total[i : i + CHUNK]) for i in at], pa.binary())], names=["at", "part", "sums"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], squeeze(sum(unsqueeze(x, np.float64) for x in pdf.sort_values("part")["sums"])))], columns=["at", "sums"])

    got = blocks.mapInArrow(run, "at long, part long, sums binary").groupBy("at").applyInPandas(add, "at long, sums binary").collect()
    scratch.drop()
    return np.concatenate([unsqueeze(r["sums"], np.float64) for r in sorted(got, key=lambda r: r["at"])] or [np.zeros(0)])


def chosen(blocks: DataFrame, judged: Callable, cuts: list[int]) -> DataFrame:
    """Of all blocks the documents that either view is sure of, with the labels that teach the text and the metadata view (-1: none).

    Words are held of those that teach the text view, as the others teach by their facts alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                row, slot, share, facts = _unpacked(r)
                labels = np.stack([np.where(bins(z) >= cut, z > 0, -1) for z, cut in zip(judged(row, slot, share, facts), cuts)][::-1]).astype(np.int8)
                stay = (labels >= 0).any(axis=0)
                if stay.any():
                    of = (labels[0] >= 0)[row]
                    keys = (slot[of] << _bits(int(stay.sum())) | (np.cumsum(stay) - 1)[row[of]]).astype(np.uint64)
                    packed = [squeeze(np.frombuffer(pack_keys(keys), np.uint8)), planes(unplanes(r["counts"])[of]), *(squeeze(x) for x in (unsqueeze(r["sizes"], np.int32)[stay], facts[stay], labels[:, stay]))]
                    yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names=["n", "keys", "counts", "sizes", "facts", "labels"])
                del r, row, slot, share, facts
                release()

    return blocks.mapInArrow(run, _CHOSEN)


class Pool:
    """All unlabelled documents, in blocks of both views' features."""

    def __init__(self, blocks: DataFrame, scratch: Scratch):
        self.blocks, self.scratch, self.taught, self.turn = blocks, scratch, None, 0

    def count(self, make: Callable) -> np.ndarray:
        return summed(self.blocks, make, self.scratch)

    def choose(self, judged: Callable, cuts: list[int]) -> None:
        """Write out who teaches in this round, so that its steps read them alone."""
        self.turn += 1
        self.taught = self.scratch.write(chosen(self.blocks, judged, cuts), f"chosen{self.turn}")

    def teach(self, make: Callable) -> np.ndarray:
        return summed(self.taught, make, self.scratch)

    def end_of_round(self) -> None:
        self.scratch.drop(f"chosen{self.turn}")


def bins(z: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(z) / _BIN, BINS - 1).astype(np.int64)


class CoTrained:
    """Both views after the rounds, and how their calibrated logits are weighted."""

    def __init__(self, rows: list, x: np.ndarray, y: np.ndarray, pool: Pool | None):
        """rows and x: the two views of labelled documents (y 0 or 1), a fifth of which calibrates; pool: all unlabelled ones.

        In each round both views score the whole pool; those of the greatest confidence teach the other view by their summed gradients, on
        top of the labelled ones.
        """
        known = np.arange(len(y))
        apart, own = known[::5], np.setdiff1d(known, known[::5])
        if min((y[own] == 0).sum(), (y[own] == 1).sum(), (y[apart] == 0).sum(), (y[apart] == 1).sum()) == 0:
            apart = own = known
        self.usable = len(known) > 0 and (y == 0).any() and (y == 1).any()
        self.taught: list[tuple[int, int, int]] = []  # of each round: documents scored, labelled for the text and for the metadata view
        if not self.usable:
            return
        truth, mine, aside = y[own].astype(float), [rows[i] for i in own], [rows[i] for i in apart]
        text, meta = TextModel().fit(mine, truth), MetadataModel().fit(x[own], truth)
        parts = flat(mine)
        for turn in range(ROUNDS + 1):
            self.text, self.meta = text.frozen(), MetadataModel()
            self.meta.__dict__.update(meta.__dict__)
            self.scale = [platt(self.text.of(aside), y[apart].astype(float)), platt(self.meta.of(x[apart]), y[apart].astype(float))]
            if turn == ROUNDS:
                break
            old, (scale_t, scale_m) = (self.text, self.meta), self.scale

            def judged(row, slot, share, facts, old=old, scale=(scale_t, scale_m)):
                return [a * z + b for (a, b), z in zip(scale, (old[0].logits(row, slot, share, len(facts)), old[1].of(facts)))]

            def count(row, slot, share, facts, judged=judged):
                return np.concatenate([np.bincount(bins(z) + BINS * (z > 0), minlength=2 * BINS) for z in judged(row, slot, share, facts)]).astype(float)

            hist = pool.count(count).reshape(-1, 2, BINS)
            if not hist.size:
                break
            everything = hist[0].sum()
            above = hist.sum(axis=1)[:, ::-1].cumsum(axis=1)[:, ::-1]  # documents from each bin on
            cuts = [max(100, int(np.flatnonzero(a >= min(SHARE * (turn + 1) * everything, a[0]))[-1])) for a in above]
            given = [hist[k, :, cuts[k] :].sum(axis=1) for k in (0, 1)]  # by the text and by the metadata view, of label 0 and 1
            self.taught.append((int(everything), int(given[1].sum()), int(given[0].sum())))
            weigh = [_weights(truth, given[1]), _weights(truth, given[0])]
            pool.choose(judged, cuts)
            for step in range(STEPS):
                now = text.frozen(), MetadataModel()
                now[1].__dict__.update(meta.__dict__)

                def teach(row, slot, share, facts, labels, now=now, weigh=weigh, newton=step < NEWTON):
                    sure = labels >= 0
                    grad, g0 = now[0].gradient(row, slot, share, len(facts), np.maximum(labels[0], 0), weigh[0][np.maximum(labels[0], 0)] * sure[0])
                    out = [grad, [g0]]
                    if newton:
                        label = labels[1][sure[1]]
                        h, g = now[1].sums(facts[sure[1]], label, weigh[1][label])
                        out += [h.ravel(), g]
                    return np.concatenate(out)

                sums = pool.teach(teach)
                if not len(sums):  # nobody teaches; the labelled ones go on alone
                    n = len(meta.w)
                    sums = np.zeros(SLOTS + 1 + (n * n + n if step < NEWTON else 0))
                grad, g0 = text.gradient(*parts, len(own), truth, weigh[0][truth.astype(int)])
                text.step(grad + sums[:SLOTS], g0 + sums[SLOTS])
                if step < NEWTON:
                    h, g = meta.sums(x[own], truth, weigh[1][truth.astype(int)])
                    meta.step(h + sums[SLOTS + 1 : -len(g)].reshape(h.shape), g + sums[-len(g) :])
            pool.end_of_round()
        z = self.views(self.text.of(aside), x[apart])
        self.joint = platt(z.mean(axis=1), y[apart].astype(float))

    def views(self, text_logits: np.ndarray, x: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = self.scale
        return np.clip(np.stack([a * text_logits + b, c * self.meta.of(x) + d], axis=1), -12, 12)

    def combine(self, views: np.ndarray) -> np.ndarray:
        return sigmoid(self.joint[0] * views.mean(axis=1) + self.joint[1])


def co_train(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", label: str = "quality", most: int = TRAIN_DOCS) -> CoTrained:
    """Fit on at most `most` labelled documents, whose features come to the driver, and on all other ones, which count as unlabelled, by sums.

    A document with several labels has the smallest. Labels other than 0 and 1 count as 1 if positive. Without documents, or labels of both kinds, there is no model.
    """
    known = labels.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    scratch = Scratch(docs.sparkSession, "quality")
    rows = _columns(docs, text, id_).join(F.broadcast(sample(known, most, "id")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            row, slot, share = text_view(batch.column("text"))
            x, out = metadata_view(batch), []
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                own, at = np.unique(slot[a:b], return_inverse=True)
                out.append((own.astype("<i4").tobytes(), np.bincount(at, share[a:b], len(own)).astype("<f4").tobytes(), x[i].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *(pa.array(c, pa.binary()) for c in zip(*out))], names=["id", "y", "slots", "shares", "facts"])

    got = scratch.write(rows.mapInArrow(run, "id long, y int, slots binary, shares binary, facts binary"), "features").toLocalIterator()  # a partition at a time
    got = sorted(({"id": r["id"], "y": r["y"], "slots": bytes(r["slots"]), "shares": bytes(r["shares"]), "facts": bytes(r["facts"])} for r in got), key=lambda r: (r["id"], r["slots"]))
    x = np.array([np.frombuffer(r["facts"], "<f4") for r in got]).reshape(len(got), LAYOUT + 2 * BUCKETS)
    y = (np.array([r["y"] for r in got], int) > 0).astype(int)
    views = [(np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in got]
    apart = np.unique(np.array([r["id"] for r in got], np.int64))
    del got
    release()
    if not {0, 1} <= set(y.tolist()):
        return CoTrained(views, x, y, None)
    blocks = scratch.write(feature_blocks(docs, apart, text, id_), "blocks")
    model = CoTrained(views, x, y, Pool(blocks, scratch))
    del views, x
    scratch.drop("blocks", "features")
    release()
    return model


def score(docs: DataFrame, model: CoTrained, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, text_score, metadata_score, score (0 to 1, higher is better), keep (score of 0.5 or more).

    Null text is empty; lang, source or n_chars that are null or missing count as '' and as the text's size. Repeated rows
    score alike. Without labels of both kinds there is no model: scores are 1 and everything stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = batch.num_rows
            if model.usable:
                views = model.views(model.text.logits(*text_view(batch.column("text")), n), metadata_view(batch))
                own, whole = sigmoid(views), model.combine(views)
            else:
                own, whole = np.ones((n, 2)), np.ones(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in (own[:, 0], own[:, 1], whole, whole >= KEEP))], names=["id", "text_score", "metadata_score", "score", "keep"])

    return _columns(docs, text, id_).mapInArrow(run, "id long, text_score double, metadata_score double, score double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, co_train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("id", "doc_id")


def keep_good(docs: DataFrame, model: CoTrained, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that the model keeps. Nothing is shuffled."""
    facts = _columns(docs, text, id_)
    names = dict(zip(facts.columns, fresh(docs, *(f"quality_{c}" for c in facts.columns))))
    whole = docs.withColumns({names["text"]: F.col(text).cast("string")})
    columns, has = docs.columns, {c.lower() for c in docs.columns}
    for c in ("lang", "source"):
        slot = F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(BUCKETS)).cast("int") if c in has else F.lit(0)
        whole = whole.withColumn(names[c], slot)
    whole = whole.withColumn(names["n_chars"], F.col("n_chars").cast("double") if "n_chars" in has else F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names["text"]):
            own = pa.RecordBatch.from_arrays([batch.column(names[c]) for c in ("text", "lang", "source", "n_chars")], names=["text", "lang", "source", "n_chars"])
            views = model.views(model.text.logits(*text_view(own.column("text")), own.num_rows), metadata_view(own))
            yield batch.select(columns).filter(pa.array(model.combine(views) >= KEEP))

    return whole.mapInArrow(run, docs.schema) if model.usable else docs
