"""Best-fit packing in bulk-synchronous rounds of distributed successor sweeps over range-sorted pieces and gaps."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, lower_ascii, mix, slices, utf8, words_of

CAPACITY = 2048
#: Bytes of text that are split into words at once.
SLICE = 2 << 20
#: Words whose ids a worker remembers, about 100 bytes each.
REMEMBERED = 800_000
#: A round takes the pieces that are at least this share of the longest one left, less that share of the capacity.
BAND, GRAIN = 2 / 3, 1 / 128
#: Pieces and gaps that one range of a sweep holds, about.
RANGE_ROWS = 400_000
#: Bits of a sequence's hash by which those are chosen that offer slots, where there are more slots than pieces.
HASH_BITS = 10


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of up to so many bytes are compared as so many 64-bit lanes; longer ones are looked up by their bytes.
_WIDE, _LANES = 32, 4
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Small letters, plain and of Latin-1: single pre-tokens that no normalization changes.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
#: Bytes of marks; and those that end a letter or digit of ASCII, or, after 0xC3, a small letter of Latin-1.
_MARK, _ENDS, _ENDS_TWO = (np.zeros(256, bool) for _ in range(3))
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_ENDS[[b for b in range(128) if chr(b).isalnum()]] = True
_ENDS_TWO[[b for b in range(0xA0, 0xC0) if b != 0xB7]] = True


def _shown() -> dict[int, int]:
    """How byte-level BPE writes bytes as characters: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


_SHOWN = _shown()


class WordIds:
    """The ids of texts, from those of their white-space separated words, remembered up to a number of words.

    The tokenizer drops white space, and no token crosses it, so a text's ids are those of its words in turn. Marks that end a word
    after a letter or a digit are tokens of their own, so what is before them and they are looked up apart. Words are found by
    a hash and compared by their bytes, in small letters but where that could change their ids: where
    a capital may be composed with what follows it, and in words with the beginning of a special token.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, at_once: int = 20_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.remembered, self.at_once = self.tokenizer.model, remembered, at_once
        self._clear()

    def _clear(self) -> None:
        """Entry 0 is the end of a text."""
        self.keys, self.found = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their entries
        self.other: dict[bytes, int] = {}  # words that are found by their bytes
        self.lanes, self.counts, self.flat = np.zeros((_LANES, 1), np.uint64), np.array([1]), np.zeros(1, np.uint32)

    def tokens(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest, plain, one = [], _LETTERS.fullmatch, self.model.tokenize
        for k, word in enumerate(words):
            if len(word) <= 64 and plain(word):
                out[k] = [t.id for t in one(word.decode("latin-1").translate(_SHOWN))]
            else:
                rest.append(k)
        for i in range(0, len(rest), self.at_once):
            some = rest[i : i + self.at_once]
            for k, got in zip(some, self.tokenizer.encode_batch_fast([words[k].decode("utf-8", "replace") for k in some], add_special_tokens=False)):
                out[k] = got.ids
        return out

    def _add(self, words: list[bytes], lanes: np.ndarray) -> np.ndarray:
        """New entries for words; their numbers."""
        ids = self.tokens(words)
        first = len(self.counts)
        self.counts = np.concatenate([self.counts, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
        self.lanes = np.concatenate([self.lanes, lanes], axis=1)
        return np.arange(first, first + len(words))

    def entries(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """The entry of each word of the bytes; odd ones are found by their bytes as they are, the others in small letters."""
        if len(self.counts) > self.remembered:
            self._clear()
        folded = np.concatenate([lower_ascii(data), np.zeros(_WIDE + 8, np.uint8)])
        odd = odd | (end - begin > _WIDE)
        plain = np.flatnonzero(~odd)
        b, size = begin[plain], (end - begin)[plain]
        view = np.ndarray(len(folded) - 7, "<u8", folded, strides=(1,))
        lanes = np.zeros((_LANES, len(plain)), np.uint64)
        h = np.zeros(len(plain), np.uint64)
        for k in range(_LANES):
            some = np.flatnonzero(size > 8 * k) if k else slice(None)
            lanes[k, some] = view[b[some] + 8 * k] & _MASKS[np.minimum(size[some] - 8 * k, 8)]
            h[some] = mix(h[some] + lanes[k, some] + np.uint64(0x9E3779B97F4A7C15))
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        there = np.minimum(at, max(len(self.keys) - 1, 0))
        found = np.where(self.keys[there] == keys, self.found[there], -1) if len(self.keys) else np.full(len(keys), -1)
        new = np.flatnonzero(found < 0)
        if len(new):
            low = folded.tobytes()
            found[new] = self._add([low[i:j] for i, j in zip(b[first[new]].tolist(), (b + size)[first[new]].tolist())], lanes[:, first[new]])
            self.keys, self.found = np.insert(self.keys, at[new], keys[new]), np.insert(self.found, at[new], found[new])
        out = np.zeros(len(begin), np.int64)
        out[plain] = found[which]
        odd[plain[~(self.lanes[:, out[plain]] == lanes).all(axis=0)]] = True  # another word of the same hash
        rest = np.flatnonzero(odd)
        if len(rest):
            whole = data.tobytes()
            words = [whole[i:j] for i, j in zip(begin[rest].tolist(), end[rest].tolist())]
            unseen = [w for w in dict.fromkeys(words) if w not in self.other]
            self.other.update(zip(unseen, self._add(unseen, np.zeros((_LANES, len(unseen)), np.uint64)).tolist()))
            out[rest] = [self.other[w] for w in words]
        return out

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, each with id 0 at its end, and where each begins and the last ends."""
        data, at = utf8(column)
        begin, end, row = words_of(data, at)
        if len(begin):
            odd = np.zeros(len(begin), bool)
            capital = (data[:-1] >= 65) & (data[:-1] <= 90)
            beside = np.flatnonzero(capital & (data[1:] >= 128) | (data[:-1] == 60) & (data[1:] == 124))
            own = np.searchsorted(begin, beside, "right") - 1
            odd[own[(own >= 0) & (beside < end[own])]] = True
            core = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[end - 1] + 1  # where the marks at its end begin
            last = data[core - 1]
            split = ~odd & (core < end) & (core > begin) & (_ENDS[last] | _ENDS_TWO[last] & (core - 2 >= begin) & (data[core - 2] == 0xC3))
            after = np.flatnonzero(split) + 1
            begin, end = np.insert(begin, after, core[split]), np.insert(np.where(split, core, end), after, end[split])
            row, odd = np.insert(row, after, row[split]), np.insert(odd, after, False)
        entry = self.entries(data, begin, end, odd) if len(begin) else np.zeros(0, np.int64)
        n = np.bincount(row, minlength=len(column)) + 1
        last = np.cumsum(n) - 1
        turn = np.zeros(int(n.sum()), np.int64)
        inside = np.ones(len(turn), bool)
        inside[last] = False
        turn[inside] = entry
        counts, starts = self.counts[turn], (np.cumsum(self.counts) - self.counts)[turn]
        ends = np.cumsum(counts)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)]
        return ids.astype("<u4"), np.concatenate([[0], ends[last]])


def token_pieces(docs: DataFrame, path: str, text: str = "text", id_: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every document cut into pieces of at most capacity ids; id 0 ends each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in slices(batches, "text", SLICE):
            ids, at = words.of(batch.column("text"))
            size = np.diff(at)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(batch.num_rows), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            first = (at[doc] + start) * 4
            held = memoryview(ids.tobytes())
            crc = [zlib.crc32(held[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nested(opens: np.ndarray) -> np.ndarray:
    """Which place of each closing one opened it last, as brackets do; -1 for those without one and for opening ones. opens: whether each place opens."""
    if not len(opens):
        return np.zeros(0, np.int64)
    depth = np.cumsum(np.where(opens, 1, -1))
    level = np.where(opens, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    before = np.concatenate([[-1], order[:-1]])
    pairs = ~opens[order] & (before >= 0)
    pairs &= (level[before] == level[order]) & opens[before]
    out = np.full(len(opens), -1, np.int64)
    out[order[pairs]] = before[pairs]
    return out


def carried(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Pairs of what the ranges left, by (range, pieces left, gaps left), in order: (piece's range, first piece, gap's range, last gap, how many).

    Ranges run from large to small; the pieces that a range leaves come before its gaps, and take the last gaps of the nearest range that has any.
    """
    out, stack = [], []
    for range_, pieces, gaps in left:
        at = 0
        while at < pieces and stack:
            r, n = stack.pop()
            k = min(n, pieces - at)
            out.append((range_, at, r, n - 1, k))
            at += k
            if n > k:
                stack.append((r, n - k))
        if gaps:
            stack.append((range_, gaps))
    return out


_SWEPT = "what int, range int, at long, key long, size long, seq long"
PLACED, PIECE, GAP = 0, 1, 2


def sweep(items: DataFrame) -> DataFrame:
    """Rows (what, range, at, key, size, seq) from items (kind, size, key): gaps (kind 0, key a sequence) and pieces (kind 1), sorted by range.

    Within its range each piece, from the largest on, takes the smallest gap that fits and that no larger piece has taken: PLACED rows.
    What finds nobody in its range is numbered (at) as it comes: PIECE and GAP rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        kind, size, key = (np.concatenate(c) for c in zip(*held))
        opener = nested(kind == 0)
        placed = np.flatnonzero(opener >= 0)
        free = opener < 0
        free[opener[placed]] = False
        pieces, gaps = np.flatnonzero(free & (kind == 1)), np.flatnonzero(free & (kind == 0))
        part, none = TaskContext.get().partitionId(), np.full(max(len(pieces), len(gaps), 1), -1, np.int64)
        for what, at, keys, sizes, seqs in ((PLACED, np.zeros(len(placed), np.int64), key[placed], size[placed], key[opener[placed]]),
                                            (PIECE, np.arange(len(pieces)), key[pieces], size[pieces], none[: len(pieces)]), (GAP, np.arange(len(gaps)), none[: len(gaps)], size[gaps], key[gaps])):
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), what, np.int32)), pa.array(np.full(len(keys), part, np.int32)), *(pa.array(x.astype(np.int64)) for x in (at, keys, sizes, seqs))], names=["what", "range", "at", "key", "size", "seq"])

    return items.mapInArrow(run, _SWEPT)


def numbered(swept: DataFrame, pairs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The rows of a sweep with the number of the pair that ranges leave each other; null for all others."""
    p = np.array(pairs, np.int64).reshape(-1, 5)
    base = np.cumsum(p[:, 4]) - p[:, 4]
    sides = []  # by range and first number of each run of pairs, for pieces and for gaps, which are taken last first
    for range_, first in ((p[:, 0], p[:, 1]), (p[:, 2], p[:, 3] - p[:, 4] + 1)):
        order = np.lexsort([first, range_])
        sides.append(((range_ << 40 | first)[order], p[order, 4], base[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            what, at = b.column("what").to_numpy(), b.column("range").to_numpy().astype(np.int64) << 40 | b.column("at").to_numpy()
            pair = np.full(len(at), -1, np.int64)
            for kind, (start, n, begin) in zip((PIECE, GAP), sides):
                own = np.flatnonzero(what == kind) if len(start) else np.zeros(0, np.int64)
                k = np.searchsorted(start, at[own], "right") - 1
                own, k = own[k >= 0], k[k >= 0]
                beyond = at[own] - start[k]
                hit = beyond < n[k]
                own, k, beyond = own[hit], k[hit], beyond[hit]
                pair[own] = begin[k] + (beyond if kind == PIECE else n[k] - 1 - beyond)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pair, pa.int64(), mask=pair < 0)], names=[*b.schema.names, "pair"])

    return swept.mapInArrow(run, f"{_SWEPT}, pair long")


def offers(sequences: DataFrame, gaps: dict[int, int], least: int, longest: int, pieces: int) -> tuple[DataFrame, int]:
    """(kind, size, key) of the slots that gaps of least or more offer to so many pieces of up to longest, and about how many they are.

    A gap offers itself, or as many slots of longest as fit into it, the last of which has what is left over. gaps: how many there are of each size.
    Pieces that find no smaller gap take slots of longest, those of the sequences of the largest hashes first, as a sweep sorts them. Where there
    are more than pieces, the sequences of smaller hashes would not be reached, and of those only the gaps smaller than longest are offered.
    """
    there = sequences.where(F.col("gap") >= least).withColumn("more", F.greatest(F.floor(F.col("gap") / longest) - 1, F.lit(0)).cast("long"))
    offered, full = there.withColumn("n", F.least("more", F.lit(pieces))), sum(k * max(n // longest - 1, 0) for n, k in gaps.items())
    if full > pieces:
        top = F.expr(f"shiftright(xxhash64(seq), {64 - HASH_BITS})")
        enough, reached = 0, None
        for reached, n in sorted(offered.where("n > 0").groupBy(top.alias("top")).agg(F.sum("n")).collect(), reverse=True):
            enough += n
            if enough >= pieces:
                break
        offered = offered.where((F.col("gap") < longest) | (top >= reached))
    offered = offered.withColumn("k", F.explode(F.expr("sequence(0, n)")))
    rows = offered.select(F.lit(0).alias("kind"), F.expr(f"if(k > 0, {longest}L, gap - more * {longest}L)").alias("size"), F.col("seq").alias("key"))
    return rows, min(full, pieces) + sum(gaps.values())


def assign(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """(key, seq, offset) for pieces (key, length up to capacity): best fit, the longest first, in rounds.

    A round takes the pieces of about BAND of the longest length left or more, and those that found no place before. A sequence offers its gap, or as many slots as such pieces
    fit into it, but all sequences no more slots than the pieces can reach (offers). Pieces and slots are sorted by size into ranges, each of which matches its own; what ranges leave is matched by their counts,
    one row a range on the driver, and meets in a join by the number of the pair. Where several lengths want a gap, the longest has it, and
    the others meet the next larger one. Then gaps shrink, and the next round begins. Where no gap holds the longest piece, as many sequences
    are opened as the pieces need that fit nowhere: one for each over half the capacity, or their sum by the capacity, if that is more.

    The driver also sees how many pieces and gaps there are of each size: at most two numbers a size, up to the capacity.
    """
    spark = scratch.spark
    waiting = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # not in a round yet
    tried: dict[int, int] = {}  # were in a round and have no place
    gaps: dict[int, int] = {}
    rest = sequences = None
    done, opened, turn, lowest = [], 0, 0, capacity + 1  # pieces of length lowest or more have been tried
    while waiting or tried:
        total = {n: waiting.get(n, 0) + tried.get(n, 0) for n in {*waiting, *tried}}
        longest = max(total)
        least = max(1, int(longest * BAND - capacity * GRAIN))
        homeless = {n: k for n, k in total.items() if n > max(gaps, default=0)}
        if longest in homeless:
            need = max(sum(k for n, k in homeless.items() if 2 * n > capacity), -(-sum(n * k for n, k in homeless.items()) // capacity))
            fresh = spark.range(opened, opened + need).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            sequences = fresh if sequences is None else sequences.unionByName(fresh)
            gaps[capacity] = gaps.get(capacity, 0) + need
            opened += need
        lowest, before = min(lowest, least), lowest
        taking = sum(k for n, k in total.items() if n >= lowest or n in tried)
        offered, slots = offers(sequences, gaps, min([lowest, *tried]), longest, taking)
        wanted = pieces.where((F.col("length") >= lowest) & (F.col("length") < before)).select(F.lit(1).alias("kind"), F.col("length").alias("size"), "key")
        if rest is not None:
            wanted = wanted.unionByName(rest.select(F.lit(1).alias("kind"), "size", "key"))
        sorted_ = wanted.unionByName(offered).repartitionByRange(int((taking + slots) // RANGE_ROWS) + 1, F.desc("size"), "kind", F.xxhash64("key"))
        swept = scratch.write(sweep(sorted_.sortWithinPartitions(F.desc("size"), "kind", F.xxhash64("key"))), f"swept{turn}")
        left: dict[int, list[int]] = {}
        for r in swept.where(F.col("what") != PLACED).groupBy("range", "what").agg(F.count("*").alias("n")).collect():
            left.setdefault(r["range"], [0, 0])[r["what"] - 1] = r["n"]
        pairs = carried([(k, *left[k]) for k in sorted(left)])
        named = numbered(swept, pairs)
        placed = swept.where(F.col("what") == PLACED).select("key", "seq", F.col("size").alias("length"))
        if pairs:
            met = named.where((F.col("what") == PIECE) & F.col("pair").isNotNull()).select("pair", "key", F.col("size").alias("length"))
            placed = placed.unionByName(met.join(named.where((F.col("what") == GAP) & F.col("pair").isNotNull()).select("pair", "seq"), "pair").select("key", "seq", "length"))
        both = sequences.select(F.lit(None).cast("long").alias("key"), "seq", "gap", F.lit(0).cast("long").alias("length")).unionByName(placed.withColumn("gap", F.lit(None).cast("long")))
        whole = Window.partitionBy("seq")
        both = both.withColumn("gap", F.max("gap").over(whole)).withColumn("taken", F.sum("length").over(whole.orderBy(F.asc_nulls_first("key")).rowsBetween(Window.unboundedPreceding, -1)))
        both = both.withColumn("all", F.sum("length").over(whole))
        both = scratch.write(both.select("key", "seq", F.expr(f"if(key is null, gap - all, {capacity} - gap + taken)").alias("value")), f"round{turn}")
        done.append(both.where("key is not null").select("key", "seq", F.col("value").alias("offset")))
        now = both.where("key is null and value > 0").select("seq", F.col("value").alias("gap"))
        rest, sequences = named.where((F.col("what") == PIECE) & F.col("pair").isNull()).select("key", "size"), now
        sizes = now.select(F.lit(0).alias("kind"), F.col("gap").alias("size")).unionByName(rest.select(F.lit(1).alias("kind"), "size")).groupBy("kind", "size").agg(F.count("*").alias("n")).collect()
        gaps, tried = ({r["size"]: r["n"] for r in sizes if r["kind"] == k} for k in (0, 1))
        waiting = {n: k for n, k in waiting.items() if n < lowest}
        if turn:
            scratch.drop(f"swept{turn - 1}", collect=False)
        turn += 1
    scratch.drop()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with length, from 1 to capacity) plus sequence_id and offset, in few sequences, gapless from 0."""
    keyed = scratch.write(pieces.withColumn("piece_key", F.monotonically_increasing_id()), "keyed")
    if keyed.isEmpty():
        return keyed.drop("piece_key").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    places = assign(keyed.select(F.col("piece_key").alias("key"), "length"), scratch, capacity)
    places = places.select(F.col("key").alias("piece_key"), F.col("seq").alias("sequence_id"), "offset")
    return keyed.join(places, "piece_key").drop("piece_key")


def packed(docs: DataFrame, path: str | None = None, text: str = "text", id_: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and leaves the one end id. Strings of special tokens in a text give those tokens' ids, as the tokenizer has it by
    default. Rows that repeat an id are packed each on its own. Null ids are carried. Other columns are ignored. No rows in, no rows out.
    """
    return pack(token_pieces(docs, path or tokenizer_path(), text, id_, capacity), Scratch(docs.sparkSession, "packing"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
