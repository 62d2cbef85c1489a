"""Exact copies, near copies and repeated passages, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from labelcube.llm import exact_dedup, simhash, substring
from labelcube.llm.common import Scratch, components

ODD = [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, "  "), (None, "a b c"), (7, None), (2, "a b c"), (8, "x" * 200_000), (None, "alone"), (9, "a b c")]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_groups(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in ODD:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, keep[norm(t)], len(groups[norm(t)]), i is not None and i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ODD]
    got = exact_dedup.exact_groups(docs(ODD))
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_dedup_keeps_one_row_and_all_columns(docs):
    table = docs(ODD)
    left = exact_dedup.exact_dedup(table)
    assert left.columns == table.columns
    assert rows(left, "doc_id") == [(1,), (3,), (5,), (8,), (9,), (None,)]  # a text without any id stays too


def test_exact_of_nothing(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0
    assert exact_dedup.exact_dedup(docs([])).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, radius=3):
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(fps))]
        if new == label:
            return label
        label = new
    return label


def test_near_duplicates(docs, words):
    base = words(300, 1).split()
    table = [(100, " ".join(base)), (5, " ".join([*base[:299], "zz"])), (50, " ".join(["yy", *base[1:]])), (7, words(300, 2)), (8, words(4, 3)), (9, "One two"), (3, "one  TWO"), (11, None), (12, " "), (12, " "), (13, words(20_000, 4)), (None, words(300, 2))]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs(table)).collect()}
    fps = [fingerprint(t) for _, t in table]
    label = linked(fps)
    for k, (i, _) in enumerate(table):
        ids = [table[j][0] for j in range(len(table)) if label[j] == label[k] and table[j][0] is not None]
        assert got[i, f"{fps[k]:016x}"] == min(ids)
    assert simhash.near_duplicates(docs(table)).count() == len(table)
    stay = simhash.one_per_group(docs(table))
    assert stay.columns == docs(table).columns
    assert simhash.near_duplicates(docs([])).count() == 0


def test_tiles_find_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    every = np.unique(np.concatenate([base, near]))
    fps = [int(x) for x in every]
    want = linked(fps)

    def found(pairs):
        label = {x: x for x in fps}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in pairs:
            a, b = root(int(a)), root(int(b))
            label[max(a, b)] = min(a, b)
        return [fps.index(root(x)) for x in fps]

    assert found(zip(*simhash.tile_links(every, None, tile=16))) == want
    halves = every[::2], every[1::2]
    pairs = [p for links in (simhash.tile_links(halves[0], None, tile=16), simhash.tile_links(halves[1], None, tile=16), simhash.tile_links(*halves, tile=16)) for p in zip(*links)]
    assert found(pairs) == want


def test_blocks_find_all_links(spark, words):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 200)
    fps = np.unique(np.concatenate([base, base[:100] ^ (1 << 5) ^ (1 << 40)]))
    scratch = Scratch(spark, "test")
    edges = simhash.linked(spark.createDataFrame([(int(x),) for x in fps], "fp long"), scratch, block=32)
    roots = {r["node"]: r["root"] for r in components(edges, scratch).collect()}
    unsigned = [int(x) & (2**64 - 1) for x in fps]
    label = linked(unsigned)
    for i, x in enumerate(fps):
        group = [int(fps[j]) for j in range(len(fps)) if label[j] == label[i]]
        assert roots.get(int(x), int(x)) == min(group)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, x) for x in range(501, 560)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert {x: got.get(x, x) for x in label} == label


def brute(table, size):
    words = [(t or "").encode().split() for _, t in table]
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in table]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(table, words):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs, words):
    passage = words(60, 9)
    table = [(1, f"{words(50, 1)} {passage} {words(30, 2)}"), (2, f"{passage}\n{words(80, 3)}"), (3, words(200, 4)), (4, words(200, 4)), (5, None), (6, ""), (7, "same " * 90), (8, words(34, 9)), (None, f"{words(12, 6)} {passage}"),
             (10, f"{passage} {words(3, 7)} {passage}"), (11, words(30_000, 8, 30_000)), (3, words(200, 4)), (12, "é" + passage)]
    for options in ({}, {"batches": 3, "fanout": 2}):
        got = substring.removals(docs(table), **options)
        assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(table, 35)
    assert substring.removals(docs([])).count() == 0


def test_shorter_windows(docs, words):
    table = [(i, words(40, i % 3, 6)) for i in range(9)]
    assert rows(substring.removals(docs(table), window=6, piece=3), "doc_id", "n_words", "n_removed", "kept_sha256") == brute(table, 6)


def test_an_index_grows_by_batches(spark):
    index = substring.FingerprintIndex(Scratch(spark, "test"), fanout=2)
    batch = lambda *hashes: spark.createDataFrame([(h, i, i, 0) for i, h in enumerate(hashes)], "hash long, id long, mark long, at int")
    found = [sorted(r[0] for r in index.add(b).collect()) for b in (batch(1, 2, 2), batch(1, 3), batch(4), batch(3, 5))]
    assert found == [[2], [1], [], [3]]
    assert sorted(r[0] for r in index.repeated().collect()) == [1, 2, 3]
    assert len(index.runs) == 1 and index.occurrences().count() == 6


def test_an_index_is_taken_up_again(spark):
    batch = lambda *hashes: spark.createDataFrame([(h, i, i, 0) for i, h in enumerate(hashes)], "hash long, id long, mark long, at int")
    folder = Scratch(spark, "test-index").root
    for hashes, want in (((1, 2, 2), [2]), ((1, 3), [1]), ((4,), []), ((3, 5, 5), [3, 5]), ((2, 6), [2])):
        index = substring.FingerprintIndex.open(spark, folder, fanout=2)
        assert sorted(r[0] for r in index.add(batch(*hashes)).collect()) == want
    again = substring.FingerprintIndex.open(spark, folder, fanout=2)
    assert sorted(r[0] for r in again.repeated().collect()) == [1, 2, 3, 5]
    assert sorted(level for level, _, _ in again.runs) == [0, 2] and again.occurrences().count() == 9
