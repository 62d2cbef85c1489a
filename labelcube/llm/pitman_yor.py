"""A hierarchical Pitman-Yor language model: bigram restaurants whose parent is the unigram restaurant."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, lower_ascii, mix, release, slices, span_hashes, utf8, words_of

#: The fold of crc32(doc_id as text) mod 7 that nothing is learned from.
FOLDS, HELD_OUT = 7, 2
#: Tokens of a block, words of a word shard, and pairs of a pair shard, about.
BLOCK_TOKENS, SHARD_WORDS, SHARD_PAIRS = 1_000_000, 1_000_000, 1_000_000
#: Sweeps of the sampler that are left out, the first of which starts from one table a pair, and sweeps that are averaged.
BURN_IN, SAMPLES = 3, 4
STRENGTH = 1.0
#: Customers of a dish up to which the chances of its numbers of tables come by the recurrence; of more, by an integral. Both are exact.
RECURRED = 2048
#: Numbers handled at once where chances are worked out.
CELLS = 1 << 18
#: For seat(): customers of a dish that are seated one by one; further ones by a draw for groups of a sixteenth of those seated.
ONE_BY_ONE, PART = 64, 16
#: Stand for the end of a text and for what is before its first word.
END, START = np.uint64(0x9A1B5C2D7E3F4081), np.uint64(0x1C6E9B3A5D7F2048)


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unsqueeze(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the first one and as many low bytes of the steps as any step needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    wide = (int(steps.max(initial=np.uint64(0))).bit_length() + 7) // 8
    return struct.pack("<QB", int(keys[0]), wide) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    first, wide = struct.unpack("<QB", data[:9])
    steps = np.zeros((n, 8), np.uint8)
    steps[1:, :wide] = np.frombuffer(data[9:], np.uint8).reshape(wide, n - 1).T
    steps = steps.view(np.uint64).ravel()
    steps[0] = first
    return np.cumsum(steps, dtype=np.uint64)


def chances(seeds: np.ndarray, n: int) -> np.ndarray:
    """The n-th number in [0, 1) of each seed: the same wherever it is drawn."""
    return (mix(seeds + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * 2.0**-53


def openings(n: np.ndarray, chance: np.ndarray, seeds: np.ndarray, nth: int) -> np.ndarray:
    """How many of n customers open a table, each by the chance: a binomial draw, by its normal limit where 30 or more are on either side."""
    u = chances(seeds, nth)
    rare = np.minimum(chance, 1 - chance)
    out = np.zeros(len(n), np.int64)
    many = n * rare >= 30
    if many.any():
        far = np.sqrt(-2 * np.log1p(-u[many])) * np.cos(2 * np.pi * chances(~seeds[many], nth))
        out[many] = np.clip(np.rint(n[many] * rare[many] + far * np.sqrt(n[many] * rare[many] * (1 - rare[many]))), 0, n[many])
    few = np.flatnonzero(~many)
    m, q, left = n[few], rare[few], u[few]
    share, k = (1 - q) ** m, 0
    while len(few):
        go = (left >= share) & (k < m)
        few, m, q, left, share = few[go], m[go], q[go], left[go] - share[go], share[go]
        share, k = share * (m - k) / (k + 1) * q / (1 - q), k + 1
        out[few] = k
    return np.where(chance > 0.5, n - out, out)


def seat(counts: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of each dish, of `counts` customers that come in one after another, by the Chinese restaurant process: a start for the sampler.

    parent: the dish's probability in the parent restaurant; others: tables of other dishes in its restaurant. The first
    customer opens a table; each later one opens another by its share of (strength + discount * tables) * parent against the
    customers less discounts at the dish's tables.
    """
    tables = np.minimum(counts, 1).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    c, p, o, s = counts[order], parent[order], others[order], seeds[order]
    t, n = tables[order], 1
    while True:
        alive = int(np.searchsorted(-c, -n, "left"))
        if alive == 0:
            break
        most = n // PART if n >= ONE_BY_ONE else 1
        group = np.minimum(most, c[:alive] - n)
        new = (strength + discount * (o[:alive] + t[:alive])) * p[:alive]
        chance = np.clip(new / (new + n + (group - 1) / 2 - discount * t[:alive]), 0, 1)
        t[:alive] += chances(s[:alive], n) < chance if most == 1 else openings(group, chance, s[:alive], n)
        n += most
    tables[order] = t
    return tables


def start_sizes(counts: np.ndarray, tables: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Customers of each table, a dish's tables in a row: one each, and the rest by random shares that are as uneven as the discount has it."""
    dish = np.repeat(np.arange(len(counts)), tables)
    first = np.cumsum(tables) - tables
    share = (-np.log1p(-chances(seeds[dish] + mix((np.arange(len(dish)) - first[dish]).astype(np.uint64)), 1))) ** (1 / (1 - discount)) + 1e-300
    ends = np.cumsum(share)
    before = np.concatenate([[0], ends])[first][dish]
    whole = np.maximum((ends[first + tables - 1][dish] - before), 1e-300)
    upto = np.rint(np.minimum((ends - before) / whole, 1) * (counts - tables)[dish]).astype(np.int64)
    upto[first + tables - 1] = counts - tables
    low = np.concatenate([[0], upto[:-1]])
    low[first] = 0
    return 1 + np.maximum(upto - low, 0)


def gibbs(counts: np.ndarray, sizes: np.ndarray, tables: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, seeds: np.ndarray, moves: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A sweep of Gibbs sampling a customer at a time, which reseat() does at once: table sizes and numbers of tables after it.

    `moves` times, or as often as the dish has customers, which is also the default, one customer of each dish, any of them alike, leaves its table and takes a seat by the conditional
    distribution given all others: a table of its dish by its customers less the discount, a new one by (strength + discount * tables of the
    restaurant) * parent. sizes holds the dishes' tables in a row; parent and others are as in seat().
    """
    moves = int(counts.max(initial=0)) if moves is None else moves
    order = np.argsort(-counts, kind="stable")
    c, t, p, o, s = counts[order], tables[order].astype(np.int64), parent[order], others[order], seeds[order]
    room = np.minimum(c, t + moves)
    edge = np.concatenate([[0], np.cumsum(room)])
    first = edge[:-1]
    n = np.zeros(edge[-1], np.int64)

    def places(t: np.ndarray) -> np.ndarray:
        return np.arange(t.sum()) + np.repeat(first - (np.cumsum(t) - t), t)

    begin = np.cumsum(tables) - tables
    n[places(t)] = sizes[np.arange(t.sum()) + np.repeat(begin[order] - (np.cumsum(t) - t), t)]
    before = np.cumsum(c) - c
    for k in range(moves):
        m = int(np.searchsorted(-c, -k, "left"))  # dishes of more than k customers
        if not m:
            break
        at, e = first[:m], edge[m]
        who = before[:m] + np.minimum((chances(s[:m], 2 * k + 1) * c[:m]).astype(np.int64), c[:m] - 1)
        seat_ = np.searchsorted(np.cumsum(n[:e]), who, "right")
        n[seat_] -= 1
        gone = n[seat_] == 0
        t[:m] -= gone
        last, empty = (at + t[:m])[gone], seat_[gone]
        n[empty] = n[last]
        n[last] = 0  # tables stay in a row
        old, new = c[:m] - 1 - discount * t[:m], (strength + discount * (o[:m] + t[:m])) * p[:m]
        u = chances(s[:m], 2 * k + 2) * (old + new)
        joins = (u < old) & (t[:m] > 0)
        weights = np.cumsum(n[:e] - discount * (n[:e] > 0))
        base = np.concatenate([[0.0], weights])[at]
        found = np.clip(np.searchsorted(weights, base + u, "right"), at, at + np.maximum(t[:m] - 1, 0))
        seat_ = np.where(joins, found, at + t[:m])
        n[seat_] += 1
        t[:m] += ~joins
    out_t = np.empty_like(t)
    out_t[order] = t
    begin = np.cumsum(out_t) - out_t
    out = np.empty(int(t.sum()), np.int64)
    out[np.arange(t.sum()) + np.repeat(begin[order] - (np.cumsum(t) - t), t)] = n[places(t)]
    return out, out_t


def saddle(c: int, discount: float, under: Callable) -> float:
    """The log of 1 - z up to which under(t, f) holds, where z is the saddle point of f ** t / z ** (c + 1) and f is 1 - (1 - z) ** discount."""
    low, high = -700.0, -1e-12
    for _ in range(60):
        x = (low + high) / 2
        f = -math.expm1(discount * x)
        low, high = (x, high) if under((c + 1) * math.exp((1 - discount) * x) * f / (discount * -math.expm1(x)), f) else (low, x)
    return x


def coefficients(c: int, t: int, discount: float) -> tuple[int, np.ndarray]:
    """(first, logs): logs of the coefficients of z ** c in (1 - (1 - z) ** discount) ** k, for k = first, first + 1 ... around t.

    By the trapezoidal rule, which converges geometrically here, around 0 through the saddle point or next to it: on a circle unless that
    is very near the branch point 1, else on a parabola around the cut beyond 1.
    """
    x = saddle(c, discount, lambda at, f: at < t)
    if x > math.log(0.05):
        z0 = max(-math.expm1(x), 0.5 / c)
        f = -math.expm1(discount * math.log1p(-z0))
        m, q = z0 * discount * (1 - z0) ** (discount - 1) / f, z0 * z0 * discount * (1 - discount) * (1 - z0) ** (discount - 2) / f
        wide = math.sqrt(max(t * (m + q - m * m), 0))
        n = 2 * int(7 * wide - 20 / math.log(z0) + 20)
        angle = np.arange(n // 2 + 1) * (2 * math.pi / n)
        inside = -np.expm1(discount * np.log1p(-z0 * np.exp(1j * angle)))
        logs, times = -c * 1j * angle, np.where(np.arange(n // 2 + 1) % (n // 2) == 0, 1.0, 2.0)
        whole = -c * math.log(z0) - math.log(n)
    else:
        w0 = max(math.exp(x), 4 / c)
        f = 1 - w0**discount
        bend = t * discount * w0 ** (discount - 2) * ((1 - discount) * f - discount * w0**discount) / f**2 + (c + 1) / (1 - w0) ** 2
        wide = 1 / (2 * w0 * math.sqrt(bend)) if bend > 0 else 1.0
        step = min(0.05, wide / 2)
        v = np.arange(int(max(10 * wide, 5) / step)) * step
        w = w0 * (1 + 1j * v) ** 2
        inside = 1 - w**discount
        logs, times = -(c + 1) * (np.log1p(-w) - math.log1p(-w0)), (1 + 1j * v) * np.where(v == 0, 1.0, 2.0)
        whole = -(c + 1) * math.log1p(-w0) + math.log(w0 * step / math.pi)
    r = np.log(inside) - math.log(f)
    logs = logs + t * r
    near = logs.real > -45
    g, r = (times * np.exp(logs))[near], r[near]
    y = saddle(c, discount, lambda at, _: at < (t + 1 if t < c else t - 1))
    reach = min(max(int(2 / math.sqrt(max(abs(math.log(math.expm1(discount * x) / math.expm1(discount * y))), 1e-12))), 1), 16 + t // 8, 256)  # at its ends the sum is a few orders below its terms
    k = np.arange(max(t - reach, 1), min(t + reach, c) + 1)
    rows = max(CELLS // len(g), 1)
    sums = np.concatenate([(np.exp(np.multiply.outer(k[i : i + rows] - t, r)) @ g).real for i in range(0, len(k), rows)])
    return int(k[0]), whole + k * math.log(f) + np.log(np.maximum(sums, 1e-300))


def many_tables(c: int, a: float, parent: float, discount: float) -> tuple[int, np.ndarray]:
    """(first, chances): of first, first + 1 ... tables of a dish of c customers, up to a factor, for as long as they are over 1e-12 of the greatest.

    The chance of t tables is in proportion to S(c, t) * parent ** t * a * (a + discount) * ... * (a + discount * (t - 1)), a being the strength and the
    discounts of the restaurant's other tables, and S(c, t) to the coefficient of z ** c in (1 - (1 - z) ** discount) ** t over t! * discount ** t.
    """
    x = saddle(c, discount, lambda t, f: (a + discount * t) * parent * f > (t + 1) * discount)  # where neighbours have the same chance
    t = (c + 1) * math.exp((1 - discount) * x) * math.expm1(discount * x) / (discount * math.expm1(x))
    first, logs = coefficients(c, min(max(round(t), 1), c), discount)
    while True:
        t = np.arange(first, first + len(logs))
        whole = logs + np.concatenate([[0.0], np.cumsum(np.log((a + discount * t[:-1]) * parent / ((t[:-1] + 1) * discount)))])
        open_ = whole[[0, -1]] > whole.max() - 28
        if not (open_[0] and first > 1 or open_[1] and t[-1] < c):
            return first, np.exp(whole - whole.max())
        if open_[1] and t[-1] < c:
            at, more = coefficients(c, int(t[-1]) + 1, discount)
            logs = np.concatenate([logs, more[t[-1] + 1 - at :]])
        if open_[0] and first > 1:
            at, more = coefficients(c, first - 1, discount)
            first, logs = at, np.concatenate([more[: first - at], logs])


def reseat(counts: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of each dish after all its customers, however many, have left and taken seats by the conditional distribution given all other dishes.

    That is a Gibbs move of the whole dish: given the number of tables their sizes don't matter to other dishes or to a prediction, so they are summed out and
    the number is drawn from its distribution, as in many_tables(). S(n, t) are generalised Stirling numbers, S(n + 1, t) = S(n, t - 1) + (n - discount * t) *
    S(n, t); what is carried on from n to n + 1 are their ratios at t and t - 1. parent and others are as in seat().
    """
    order = np.argsort(counts, kind="stable")
    c, p, a, u = counts[order].astype(np.int64), parent[order], strength + discount * others[order], chances(seeds, 1)[order]
    t, ratio = np.minimum(c, 1), np.zeros(0)
    short = int(np.searchsorted(c, RECURRED, "right"))
    top = int(c[short - 1]) if short else 0
    cuts = np.searchsorted(c, np.arange(top + 2))
    for n in range(2, top + 1):
        k = np.arange(1, n)
        ratio = (1 + (n - 1 - discount * (k + 1)) * np.append(ratio, 0)) / (np.concatenate([[0], 1 / ratio]) + (n - 1 - discount * k))
        step = max(CELLS // n, 1)
        for i in range(cuts[n], cuts[n + 1], step):
            j = min(i + step, cuts[n + 1])
            logs = np.zeros((j - i, n))
            np.cumsum(np.log(ratio * p[i:j, None] * (a[i:j, None] + discount * k)), axis=1, out=logs[:, 1:])
            upto = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            t[i:j] = 1 + (upto[:, :-1] <= u[i:j, None] * upto[:, -1:]).sum(axis=1)
    for i in range(short, len(c)):
        first, own = many_tables(int(c[i]), float(a[i]), float(p[i]), discount)
        upto = np.cumsum(own)
        t[i] = first + min(int(np.searchsorted(upto, u[i] * upto[-1], "right")), len(own) - 1)
    tables = np.empty_like(t)
    tables[order] = t
    return tables


def below(tables: np.ndarray, parent: np.ndarray, discount: float, strength: float = STRENGTH) -> np.ndarray:
    """What a restaurant of so many tables leaves to its parent's probability of a dish."""
    return (strength + discount * tables) * parent


def predictive(customers: np.ndarray, tables: np.ndarray, left: np.ndarray, whole: np.ndarray, discount: float, strength: float = STRENGTH) -> np.ndarray:
    """The probability of a dish with so many customers and tables in a restaurant of `whole` customers; left: what below() gives."""
    return (np.maximum(customers - discount * tables, 0) + left) / (strength + whole)


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by the place of their bytes, which packs small and close ones well."""
    return squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_ids(x: np.ndarray) -> bytes:
    """Sorted numbers below 2 ** 32."""
    return planes(np.diff(x, prepend=0))


def unpack_ids(x: bytes) -> np.ndarray:
    return np.cumsum(unplanes(x))


def _rows(rows: DataFrame, make: Callable, shape: str) -> DataFrame:
    """The rows of shape that make(row as dict) gives for each row."""
    names = [c.split()[0] for c in shape.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[c.split(" ", 1)[1]] for c in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = list(make(batch.slice(k, 1).to_pylist()[0]))
                release()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, shape)


def _groups(rows: DataFrame, make: Callable, shape: str) -> DataFrame:
    """The rows of shape that make(shard, dicts of the shard's rows by block) gives for each shard."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(list(make(int(key[0]), pdf.sort_values("block").to_dict("records"))), columns=names)
        release()
        return got

    return rows.groupBy("shard").applyInPandas(run, shape)


def _parts(done: DataFrame, name: str) -> DataFrame:
    """(block, name): the replies to a block by shard; as many as there are shards, of a block's size together."""
    return done.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "part"))).alias(name))


def _totals(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of the rows of values at each, and which of them each key is."""
    keys = np.concatenate(keys)
    found, which = np.unique(keys, return_inverse=True)
    values = np.concatenate(values, axis=1)
    return found, np.stack([np.bincount(which, v, len(found)) for v in values]).astype(np.int64), which


class Block:
    """The documents of a block: token numbers in its sorted vocabulary, and its distinct pairs of neighbours."""

    def __init__(self, vocabulary: bytes, sizes: bytes, held: bytes, tokens: bytes):
        self.words = np.frombuffer(vocabulary, np.uint64)
        self.sizes, self.held = np.frombuffer(sizes, np.int64), np.frombuffer(held, bool)
        self.tokens = unsqueeze(tokens, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = ~self.held[self.doc]
        begins = np.cumsum(self.sizes) - self.sizes
        self.context = np.concatenate([[0], self.tokens[:-1]])
        self.context[begins] = np.searchsorted(self.words, START)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context and word of the distinct pairs, in order; and the pair of each token."""
        n = len(self.words)
        code, at = np.unique(self.context * n + self.tokens, return_inverse=True)
        return code // n, code % n, at


def blocks(docs: DataFrame, text: str = "text", id_: str = "doc_id", size: int = BLOCK_TOKENS) -> DataFrame:
    """Documents by block of about `size` tokens: (block, ids, vocabulary, sizes, held, tokens)."""
    shape = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("sizes", pa.binary()), ("held", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            hashes, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            vocabulary, tokens = np.unique(np.concatenate([hashes, [START]]), return_inverse=True)
            row = {"block": [part << 24 | made], "ids": [[i for h in held for i in h[2]]], "vocabulary": [vocabulary.tobytes()], "sizes": [sizes.tobytes()],
                   "held": [np.concatenate([h[3] for h in held]).tobytes()], "tokens": [squeeze(tokens[:-1].astype(np.uint32))]}
            return pa.RecordBatch.from_pydict(row, schema=shape)

        for batch in slices(batches, "text", 1 << 20):
            data, at = utf8(batch.column("text"))
            begin, end, row = words_of(data, at)
            hashes = span_hashes(lower_ascii(data), begin, end)
            sizes = np.bincount(row, minlength=batch.num_rows) + 1
            all_ = np.full(int(sizes.sum()), END)
            ends = np.zeros(len(all_), bool)
            ends[np.cumsum(sizes) - 1] = True
            all_[~ends] = hashes
            held.append((all_, sizes.astype(np.int64), batch.column("id").to_pylist(), np.array(batch.column("held").to_pylist(), bool)))
            if sum(len(h[0]) for h in held) >= size:
                yield flush()
                made, held = made + 1, []
        if held:
            yield flush()

    rows = docs.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.crc32(F.col(id_).cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, ids array<long>, vocabulary binary, sizes binary, held binary, tokens binary")


def _block(row: dict) -> Block:
    return Block(row["vocabulary"], row["sizes"], row["held"], row["tokens"])


def pair_shards(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """Pairs are dealt by a hash of both words, so that those of one context, however many, go to all shards."""
    return (mix(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % shards


_STATE = "block long, u binary, w binary, c binary, t binary, kept binary"


def _state(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(unplanes(row[x]) for x in ("u", "w", "c", "t", "kept"))


def scores(docs: DataFrame, text: str = "text", id_: str = "doc_id", size: int = BLOCK_TOKENS, words: int = SHARD_WORDS, shard: int = SHARD_PAIRS, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learned from the rows that aren't held out, by counts over all of them: of tokens and of pairs of a token and the one
    before (or the text's start). Each context is a restaurant whose customers are the pairs' tokens; each of its tables
    sends a customer to the one unigram restaurant that all share, whose base gives each of V + 1 words alike. Discounts come from the counts of counts.

    Words are numbered in the order of their hashes, over ranges of hashes; a word's 64-bit hash stands for it. Each pair that training
    holds twice or more lies in one row of one shard, with the number of its tables; a pair seen once has one table at all times. In a sweep shards send their
    tables by word to the word shards, which seat the root, and get the sums and the parent's counts back; then all customers of each
    pair are seated again by reseat(). Shards see each other's tables as of the
    sweep before. Draws follow from the words alone, so blocks and shards don't change them. The predictive probabilities of the sweeps after the burn-in
    are averaged; score is the log10 of their product, perplexity 10 to the power of minus its mean a token.

    Documents are read once, into blocks of numbered words; their pairs travel once, combined by block, and each block gets the state of its
    pairs and words at the end. Null text has its end token alone; a null id isn't held out. Repeated rows count and score each. Other columns are
    ignored; without training rows every word is unknown. Over 2 ** 32 distinct words raise.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor")
    own = scratch.write(blocks(docs, text, id_, size), "blocks")
    held = own.agg(F.sum(F.length("vocabulary") / 8)).first()[0]
    ranges = int((held or 0) // words) + 1
    edges = np.array([(1 << 64) * k // ranges for k in range(1, ranges)], np.uint64)

    def count_words(row: dict) -> Iterator[tuple]:
        b = _block(row)
        counts = np.bincount(b.tokens, b.train, len(b.words)).astype(np.int64)
        cuts = np.concatenate([[0], np.searchsorted(b.words, edges), [len(b.words)]])
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            yield k, row["block"], int(j - i), squeeze(np.frombuffer(pack_keys(b.words[i:j]), np.uint8)), planes(counts[i:j])

    def number(k: int, rows: list[dict]) -> Iterator[tuple]:
        _, (c,), which = _totals([unpack_keys(unsqueeze(r["keys"], np.uint8).tobytes(), r["n"]) for r in rows], [unplanes(r["values"])[None] for r in rows])
        at = 0
        for r in rows:
            yield int(r["block"]), k, pack_ids(which[at : at + r["n"]]), None
            at += r["n"]
        yield -1, k, planes(c), [float(x) for x in (len(c), c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum())]

    reply = "block long, shard long, part binary, sums array<double>"
    sent = "shard long, block long, n long, keys binary, values binary"
    numbered = scratch.write(_groups(_rows(own, count_words, sent), number, reply), "numbered")
    scratch.drop()
    sums = {r["shard"]: r["sums"] for r in numbered.where("block = -1").select("shard", "sums").collect()}  # one row a range
    size_of = np.array([int(sums[k][0]) if k in sums else 0 for k in range(ranges)], np.int64)
    offset = np.cumsum(size_of) - size_of
    if size_of.sum() >= 1 << 32:
        raise ValueError(f"{size_of.sum()} distinct words; at most 2 ** 32 can be numbered")
    tokens, types, once, twice = (sum(s[k] for s in sums.values()) for k in range(1, 5))
    root = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
    base = 1 / (types + 1)
    shards = int(tokens // shard) + 1
    ids = lambda parts: np.concatenate([unpack_ids(p["part"]) + offset[p["shard"]] for p in parts])

    def by_pair(row: dict) -> tuple:
        b = _block(row)
        u, w, at = b.pairs()
        name = ids(row["word_parts"])
        to = pair_shards(name[u], name[w], shards)
        order = np.argsort(to, kind="stable")
        return b, name, u, w, at, order, np.searchsorted(to[order], np.arange(shards + 1))

    def count_pairs(row: dict) -> Iterator[tuple]:
        b, name, u, w, at, order, cuts = by_pair(row)
        counts = np.bincount(at, b.train, len(u)).astype(np.int64)[order]
        u, w = name[u[order]], name[w[order]]
        for k in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[k], cuts[k + 1]
            yield int(k), row["block"], int(j - i), pack_ids(u[i:j]), planes(w[i:j]), planes(counts[i:j])

    def count_shard(k: int, rows: list[dict]) -> Iterator[tuple]:
        keys, (c,), which = _totals([(unpack_ids(r["u"]) << 32 | unplanes(r["w"])).astype(np.uint64) for r in rows], [unplanes(r["counts"])[None] for r in rows])
        at = 0
        for r in rows:  # which of the shard's pairs a block holds
            yield "asked", k, int(r["block"]), pack_ids(which[at : at + r["n"]]), None, None, None
            at += r["n"]
        u, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield "counts", k, -1, planes(c), None, None, [float((c == 1).sum()), float((c == 2).sum())]
        more, single = c > 1, c == 1
        yield "state", k, k, planes(u[more]), planes(w[more]), planes(c[more]), None
        fixed, n, _ = _totals([u[single], w[single]], [np.repeat([[1], [0]], single.sum(), axis=1), np.repeat([[0], [1]], single.sum(), axis=1)])
        yield "fixed", k, k, pack_ids(fixed), planes(n[0]), planes(n[1]), None

    met = own.join(_parts(numbered, "word_parts"), "block")
    pairs = _rows(met, count_pairs, "shard long, block long, n long, u binary, w binary, counts binary")
    paired = scratch.write(_groups(pairs, count_shard, "kind string, shard long, block long, a binary, b binary, c binary, sums array<double>"), "paired")
    scratch.drop()
    once, twice = (x or 0 for x in paired.where("kind = 'counts'").agg(F.sum(F.col("sums")[0]), F.sum(F.col("sums")[1])).first())
    leaf = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)

    def by_range(row: dict, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
        cuts = np.concatenate([np.searchsorted(keys, offset), [len(keys)]])
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                yield k, row["block"], int(j - i), pack_ids(keys[i:j] - offset[k]), planes(np.concatenate([v[i:j] for v in values]) if values else np.zeros(0))

    def fix(k: int, rows: list[dict]) -> Iterator[tuple]:
        out = np.zeros((2, size_of[k]), np.int64)
        for r in rows:
            out[:, unpack_ids(r["keys"])] += unplanes(r["values"]).reshape(2, -1)
        yield k, -1, int(size_of[k]), None, planes(out.ravel())

    fixed = _rows(paired.where("kind = 'fixed'"), lambda row: by_range(row, unpack_ids(row["a"]), unplanes(row["b"]), unplanes(row["c"])), sent)
    fixed = scratch.write(_groups(fixed, fix, sent), "fixed")  # tables that never change: by word, as a context and as a dish

    def begin(row: dict) -> Iterator[tuple]:
        c = unplanes(row["c"])
        one = planes(np.ones(len(c)))
        yield row["block"], row["a"], row["b"], row["c"], one, planes(np.zeros(len(c)))

    state = scratch.write(_rows(paired.where("kind = 'state'"), begin, _STATE), "state0")
    scratch.drop()
    last, taken = types, []  # tables in the root: one a word, before any is sampled

    def partial(row: dict) -> Iterator[tuple]:
        u, w, _, t, _ = _state(row)
        keys, n, _ = _totals([u, w], [np.stack([t, 0 * t]), np.stack([0 * t, t])])
        return by_range(row, keys, *n)

    for sweep in range(burn_in + samples + 1):
        def seat_root(k: int, rows: list[dict], sweep: int = sweep, last: float = last) -> Iterator[tuple]:
            sums = np.zeros((2, size_of[k]), np.int64)
            for r in rows:
                sums[:, slice(None) if r["block"] < 0 else unpack_ids(r["keys"])] += unplanes(r["values"]).reshape(2, -1)
            name = (np.arange(size_of[k]) + offset[k]).astype(np.uint64)
            t = reseat(sums[1], np.full(len(name), base), np.full(len(name), max(last - 1, 0)), root, STRENGTH, mix(name + np.uint64((sweep + 1) << 48)))
            whole = np.concatenate([sums, t[None]])
            for r in rows:
                yield int(r["block"]), k, planes((whole if r["block"] < 0 else whole[:, unpack_ids(r["keys"])]).ravel()), [float(sums[1].sum()), float(t.sum())] if r["block"] < 0 else None

        done = scratch.write(_groups(_rows(state, partial, sent).unionByName(fixed), seat_root, reply), f"sweep{sweep}")
        customers, last = (x or 0.0 for x in done.where("block = -1").agg(F.sum(F.col("sums")[0]), F.sum(F.col("sums")[1])).first())
        if sweep > burn_in:
            taken.append((customers, last))

        def update(row: dict, sweep: int = sweep, customers: float = customers, total: float = last) -> Iterator[tuple]:
            u, w, c, t, kept = _state(row)
            if sweep > burn_in:  # what was seated under these sums is a sample
                kept = kept + t
            if sweep < burn_in + samples and len(u):
                keys = np.unique(np.concatenate([u, w]))
                tu, cw, tw = np.concatenate([unplanes(p["part"]).reshape(3, -1) for p in row["parts"]], axis=1)
                parent = predictive(cw, tw, below(total, base, root), customers, root)[np.searchsorted(keys, w)]
                others = tu[np.searchsorted(keys, u)] - t
                seeds = mix(mix(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)) + np.uint64(sweep))
                t = reseat(c, parent, others, leaf, STRENGTH, seeds)
            yield row["block"], row["u"], row["w"], row["c"], planes(t), planes(kept)

        state = scratch.write(_rows(state.join(_parts(done, "parts"), "block", "left"), update, _STATE), f"state{sweep + 1}")
        scratch.drop(f"state{sweep}", *([] if sweep > burn_in else [f"sweep{sweep}"]))

    def ask(row: dict) -> Iterator[tuple]:
        return by_range(row, ids(row["word_parts"]))

    def tell_words(k: int, rows: list[dict]) -> Iterator[tuple]:
        counts = [unplanes(r["values"]) for r in rows if r["block"] == -1]
        whole = np.concatenate(counts + [unplanes(r["values"]) for r in sorted((r for r in rows if r["block"] < -1), key=lambda r: -r["block"])]).reshape(1 + 3 * samples, -1)
        for r in rows:
            if r["block"] >= 0:
                yield int(r["block"]), k, planes(whole[:, unpack_ids(r["keys"])].ravel()), None

    known = numbered.where("block = -1").select("shard", "block", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("keys"), F.col("part").alias("values"))
    for k in range(samples):
        of = spark.read.schema(done.schema).parquet(f"{scratch.root}/sweep{burn_in + 1 + k}").where("block = -1")
        known = known.unionByName(of.select("shard", F.lit(-2 - k).cast("long").alias("block"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("keys"), F.col("part").alias("values")))
    told = scratch.write(_groups(_rows(_parts(numbered, "word_parts"), ask, sent).unionByName(known), tell_words, reply), "told")
    scratch.drop("fixed", *[f"sweep{burn_in + 1 + k}" for k in range(samples)])

    def tell_pairs(k: int, rows: list[dict]) -> Iterator[tuple]:
        c = next(unplanes(r["a"]) for r in rows if r["kind"] == "counts")
        whole = np.stack([c, np.where(c > 0, samples, 0)])  # customers, and tables added up over the samples
        whole[1, c > 1] = next(unplanes(r["a"]) for r in rows if r["kind"] == "state")
        for r in rows:
            if r["kind"] == "asked":
                yield int(r["block"]), k, planes(whole[:, unpack_ids(r["a"])].ravel()), None

    asked = paired.where("kind in ('asked', 'counts')").select("kind", "shard", "block", "a").unionByName(state.select(F.lit("state").alias("kind"), F.col("block").alias("shard"), "block", F.col("kept").alias("a")))
    answers = scratch.write(_groups(asked, tell_pairs, reply), "answers")
    scratch.drop("paired", f"state{burn_in + samples + 1}")

    def judge(row: dict) -> Iterator[tuple]:
        b, _, u, w, at, order, _ = by_pair(row)
        known = np.concatenate([unplanes(p["part"]).reshape(1 + 3 * samples, -1) for p in row["told_parts"]], axis=1)
        seen = np.empty((2, len(u)), np.int64)
        seen[:, order] = np.concatenate([unplanes(p["part"]).reshape(2, -1) for p in row["pair_parts"]], axis=1)
        counts, context = known[0], known[0].copy()
        start, end = np.searchsorted(b.words, START), np.searchsorted(b.words, END)
        context[start] = counts[end]  # as many texts begin as end
        left = np.zeros(len(u))
        for k, (customers, total) in enumerate(taken):
            tu, cw, tw = known[1 + 3 * k : 4 + 3 * k]
            parent = predictive(cw, tw, below(total, base, root), customers, root)
            left += below(tu[u], parent[w], leaf) / samples
        logs = np.log10(predictive(seen[0], seen[1] / samples, left, context[u], leaf))[at]
        plain = np.log10((counts + 1) / (tokens + types + 1))[b.tokens]
        docs = len(b.sizes)
        sums = [np.bincount(b.doc, x, docs) for x in ((counts[b.tokens] > 0), plain, logs)]
        for k in range(docs):
            yield row["ids"][k], bool(b.held[k]), int(b.sizes[k]), int(sums[0][k]), int(tokens), float(sums[1][k]), float(sums[2][k]), float(10 ** (-sums[2][k] / b.sizes[k]))

    final = met.join(_parts(told, "told_parts"), "block").join(_parts(answers, "pair_parts"), "block")
    return _rows(final, judge, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("id", id_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
