"""Models: toxicity, quality and language, against held-out labels, brute force and each other."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from labelcube.llm import pitman_yor, quality, toxicity

BAD = ["vile", "rotten", "awful"]


def corpus(n, seed, insult=0.4, junk=0.0):
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(500)]
    out = []
    for i in range(n):
        text, toxic, good = [], 0, 1
        for _ in range(rng.randint(2, 6)):
            text.append(" ".join(rng.choices(word, k=rng.randint(4, 12))))
        if rng.random() < insult:
            toxic, k = 1, rng.randrange(len(text))
            text[k] += " " + rng.choice(BAD) + " person"
        text = ". ".join(text) + "."
        if rng.random() < junk:
            good, text = 0, " ".join(w + "###" for w in text.split())
        out.append((i, text, toxic, good))
    return out


@pytest.fixture(scope="module")
def toxic(spark, docs_module):
    rows = corpus(400, 1)
    frame = docs_module([(i, t) for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows[:300]] + [(None, 1), (10**6, None)], "doc_id long, toxic int")
    return rows, frame, toxicity.train(frame, labels, most=300)


@pytest.fixture(scope="module")
def docs_module(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 3, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string").drop("id")

    return make


def test_toxicity_generalises_and_points_at_sentences(toxic):
    rows, frame, model = toxic
    got = {r["id"]: r for r in toxicity.score(frame, model).collect()}
    held = rows[300:]
    assert np.mean([(got[i]["score"] >= toxicity.THRESHOLD) == bool(y) for i, _, y, _ in held]) > 0.95
    for i, text, y, _ in held:
        if y and got[i]["score"] > 0.9:
            worst = got[i]["offending"][0]
            assert any(w in text.encode()[worst["begin"] : worst["end"]].decode() for w in BAD)


def test_toxicity_of_odd_texts(toxic, docs_module):
    _, _, model = toxic
    odd = [(1, None), (2, ""), (3, " .!? "), (4, "vile person " * 20_000), (5, "é"), (5, "é"), (None, "vile person")]
    got = toxicity.score(docs_module(odd), model).collect()
    score = {(r["id"], k): r["score"] for k, r in enumerate(got)}
    assert len(got) == len(odd) and all(0 <= s <= 1 for s in score.values())
    assert [r["score"] for r in got if r["id"] in (1, 2)] == [0, 0]
    assert toxicity.score(docs_module([]), model).count() == 0


def test_every_offending_sentence_is_located(docs_module):
    weights = np.zeros(toxicity.SLOTS, np.float32)
    slots = toxicity.word_features(pa.array(["vile", "rude"]), fold=True)[3]
    weights[slots[0, 0]], weights[slots[1, 0]] = 8.0, 4.5  # 0.88 and 0.18 a sentence
    texts = [(1, "vile a. " * 10 + "fine."), (2, "rude a. " * 3 + "fine."), (3, "rude a. fine."), (4, "")]
    got = {r["id"]: r for r in toxicity.score(docs_module(texts), (weights, -6.0)).collect()}
    assert [len(got[i]["offending"]) for i in (1, 2, 3, 4)] == [10, 2, 0, 0]
    assert got[2]["score"] >= 0.3 > max(x["probability"] for x in got[2]["offending"])


def test_scores_of_documents_against_a_plain_version(toxic, docs_module):
    (weights, shift), rng = toxic[2], random.Random(11)
    texts = [t for _, t, _, _ in toxic[0][:40]] + ["vile! vile vile.\nnobody", "a.b? c", "", "x" * 50 + " VILE person."]

    def plain(text):
        left, sentence, ended = 1.0, set(), False
        for word in [*text.split(), None]:
            if word is None or ended:
                if sentence:
                    left *= 1 - 1 / (1 + np.exp(-(shift + sum(float(weights[k]) for k in sentence))))
                sentence, ended = set(), False
            if word is not None:
                sentence |= set(toxicity.word_features(pa.array([word]), fold=True)[3][0].tolist())
                ended = any(c in word for c in ".!?")
        return 1 - left

    texts = [t.replace("\n", ". ") for t in texts]
    got = {r["id"]: r["score"] for r in toxicity.score(docs_module(list(enumerate(texts))), (weights, shift)).collect()}
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(plain(t), abs=1e-6), t


def test_noisy_or_is_one_minus_the_product():
    logits, rows = np.array([-1.0, 2.0, 0.5]), np.array([0, 0, 2])
    p = 1 / (1 + np.exp(-logits))
    np.testing.assert_allclose(toxicity.noisy_or(logits, rows, 3), [1 - (1 - p[0]) * (1 - p[1]), 0, p[2]])


def test_no_labels_no_model(spark, docs_module):
    frame = docs_module([(1, "a b"), (2, "c")])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert all(r["score"] < 0.05 for r in toxicity.score(frame, toxicity.train(frame, none)).collect())
    model = quality.co_train(frame, none)
    assert [r["keep"] for r in quality.score(frame, model).collect()] == [True, True]
    assert quality.keep_good(frame, model).count() == 2


def test_held_out_rows_are_those_of_the_fold(spark):
    got = {r["doc_id"]: r["held_out"] for r in toxicity.query(spark, "/root/testdata/sf0.001").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.items())


def test_gradients_of_both_views_against_plain_ones():
    rng = np.random.default_rng(12)
    row, slot, share = np.repeat(np.arange(6), 4), rng.integers(0, 50, 24), rng.random(24)
    y, weigh = np.array([0, 1, 1, 0, 1, 0]), rng.random(6)
    model = quality.TextModel()
    model.w, model.b = rng.normal(size=quality.SLOTS), 0.3
    grad, g0 = model.gradient(row, slot, share, 6, y, weigh)
    loss = lambda w, b: sum(weigh[i] * np.logaddexp(0, (1 - 2 * y[i]) * (b + sum(w[slot[k]] * share[k] for k in range(24) if row[k] == i))) for i in range(6))
    for k in slot[:5]:
        step = np.zeros(quality.SLOTS)
        step[k] = 1e-6
        assert grad[k] == pytest.approx((loss(model.w + step, 0.3) - loss(model.w - step, 0.3)) / 2e-6, rel=1e-4, abs=1e-7)
    assert g0 == pytest.approx((loss(model.w, 0.3 + 1e-6) - loss(model.w, 0.3 - 1e-6)) / 2e-6, rel=1e-4)


def test_several_labels_of_a_document(spark, docs_module):
    rows = corpus(200, 3, junk=0.3)
    frame = docs_module([(i, t) for i, t, _, _ in rows])
    once = [(i, x, g) for i, _, x, g in rows]
    twice = once + [(i, 0, 1) for i, _, _, _ in rows[:100]]  # toxic and bad prevail
    first, second = (spark.createDataFrame(x, "doc_id long, toxic int, quality int") for x in (once, twice))
    assert np.allclose(toxicity.train(frame, first)[0], toxicity.train(frame, second)[0])
    a, b = ({r["id"]: r["score"] for r in quality.score(frame, quality.co_train(frame, x)).collect()} for x in (first, second))
    assert a == pytest.approx(b)


def test_no_documents(spark, docs_module):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, toxic int, quality int")
    none = docs_module([])
    model = quality.co_train(none, labels)
    assert quality.score(none, model).count() == 0 and quality.keep_good(none, model).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_co_training(spark, docs_module):
    rows = corpus(500, 2, junk=0.3)
    frame = docs_module([(i, t) for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, g) for i, _, _, g in rows[:150]], "doc_id long, quality int")
    model = quality.co_train(frame, labels)
    got = {r["id"]: r for r in quality.score(frame, model).collect()}
    assert np.mean([got[i]["keep"] == bool(g) for i, _, _, g in rows[150:]]) > 0.97
    for view in ("text_score", "metadata_score"):
        assert np.mean([(got[i][view] > 0.5) == bool(g) for i, _, _, g in rows[150:]]) > 0.9
    left = quality.keep_good(frame, model)
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if r["keep"]}
    odd = docs_module([(1, None), (2, ""), (3, "x" * 300_000), (None, "a"), (3, "a")])
    assert quality.score(odd, model).count() == 5 and quality.score(odd.limit(0), model).count() == 0
    assert quality.score(odd.drop("lang", "source", "n_chars"), model).count() == 5


def test_every_unlabelled_document_takes_part(docs_module, spark):
    rows = corpus(3200, 5, junk=0.3)
    labels = spark.createDataFrame([(i, g) for i, _, _, g in rows[:200]], "doc_id long, quality int")
    model = quality.co_train(docs_module([(i, t) for i, t, _, _ in rows]), labels)
    assert [n for n, _, _ in model.taught] == [3000] * quality.ROUNDS
    assert max(max(t[1:]) for t in model.taught) > 251


def brute(rows):
    from collections import Counter

    tokens = {k: [*[w.lower() for w in (t or "").encode().split()], b"\0"] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, held[k], len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[k])) for k, (i, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(word, k=rng.randint(1, 60))) + " new" + str(i)) for i in range(60)]
    return [*rows, (100, None), (101, "  "), (None, "W1 w2"), (102, "the cat " * 300), (103, "the cat " * 40), (102, "the cat " * 300)]


@pytest.mark.parametrize("size", [150, 10**6])
def test_counts_and_base_scores(docs_module, texts, size):
    got = pitman_yor.scores(docs_module(texts), size=size, words=80, shard=80).collect()
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr)
    assert have == sorted(((*x[:5], round(float(x[5]), 6)) for x in brute(texts)), key=repr)
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)


def test_blocks_and_shards_do_not_matter(docs_module, texts):
    runs = [sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in pitman_yor.scores(docs_module(texts), size=s, words=w, shard=d).collect()) for s, w, d in ((150, 80, 60), (10**6, 10**6, 10**6))]
    for one, other in zip(*runs):
        assert one[:2] == other[:2] and one[2] == pytest.approx(other[2], rel=1e-9)


def test_repeated_contexts_are_learned(docs_module, texts):
    got = {(r["doc_id"], r["n_tokens"]): r for r in pitman_yor.scores(docs_module(texts)).collect()}
    assert got[103, 81]["score"] > got[103, 81]["base_score"] / 3
    assert pitman_yor.scores(docs_module([])).count() == 0


def test_keys_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.sort(rng.integers(0, 2**64 - 1, n, np.uint64))
        assert (pitman_yor.unpack_keys(pitman_yor.pack_keys(keys), n) == keys).all()


def test_words_are_held_of_those_who_teach_the_text_view_alone(docs, words):
    frame = docs([(i, words(30 + i, i)) for i in range(12)])
    held = quality.feature_blocks(frame, np.array([3, 7]), "text", "doc_id").collect()
    sure = lambda row, slot, share, facts: [np.where(np.arange(len(facts)) % 3 == 0, 9.0, 0.0), np.where(np.arange(len(facts)) % 3 == 1, -9.0, 0.0)]
    taught = quality.chosen(quality.feature_blocks(frame, np.array([3, 7]), "text", "doc_id"), sure, [100, 100]).collect()
    model = quality.TextModel()
    model.w, model.b = np.random.default_rng(2).normal(size=quality.SLOTS), 0.1
    want, got, met = np.zeros(quality.SLOTS), np.zeros(quality.SLOTS), [0, 0]
    for r in held:
        row, slot, share, facts = quality._unpacked(r.asDict())
        np.testing.assert_allclose(np.bincount(row, share, len(facts)), 5)
        want += model.gradient(row, slot, share, len(facts), np.zeros(len(facts)), np.arange(len(facts)) % 3 == 1)[0]
    for r in taught:
        row, slot, share, facts, labels = quality._unpacked(r.asDict())
        met = [m + (x >= 0).sum() for m, x in zip(met, labels)]
        assert (labels[0][row] >= 0).all()  # no words of those who teach the metadata view alone
        got += model.gradient(row, slot, share, len(facts), np.maximum(labels[0], 0), labels[0] >= 0)[0]
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert sum(met) > 0 and sum(len(quality._unpacked(r.asDict())[3]) for r in held) == 10


def test_a_fit_needs_little_memory_beside_its_features():
    import tracemalloc

    rng, n = np.random.default_rng(1), 3_000_000
    row, slot, share = np.sort(rng.integers(0, 4000, n)).astype(np.int32), rng.integers(0, quality.SLOTS, n).astype(np.int32), rng.random(n).astype(np.float32)
    model = quality.TextModel()
    model.w, model.b = rng.normal(size=quality.SLOTS), 0.2
    tracemalloc.start()
    grad, _ = model.gradient(row, slot, share, 4000, np.zeros(4000), np.ones(4000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    g = quality.sigmoid(model.b + np.bincount(row, model.w[slot] * share, 4000))
    np.testing.assert_allclose(grad, np.bincount(slot, g[row] * share, quality.SLOTS), rtol=1e-9, atol=1e-9)
    assert most < 20e6


def table_chances(c, parent, others, d, s):
    """The exact distribution of the number of tables of c customers of one dish, by generalised Stirling numbers."""
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0] + [row[t - 1] + (row[t] * (n - t * d) if t < len(row) else 0.0) for t in range(1, n + 2)]
    weights = np.array([row[t] * np.prod([(s + d * (others + j)) * parent for j in range(t)]) for t in range(1, c + 1)])
    return weights / weights.sum()


@pytest.mark.parametrize("c, parent, others, d, s, moves", [(2, 0.2, 0, 0.5, 1.0, 16), (5, 0.3, 4, 0.6, 1.0, 16), (9, 0.05, 30, 0.8, 1.0, 16), (12, 0.4, 2, 0.3, 2.0, 3)])
def test_gibbs_reaches_the_exact_distribution(c, parent, others, d, s, moves):
    n = 20_000
    counts, sizes, tables = np.full(n, c), np.full(n, c), np.ones(n, np.int64)
    for sweep in range(200 if moves < c else 12):
        sizes, tables = pitman_yor.gibbs(counts, sizes, tables, np.full(n, parent), np.full(n, others), d, s, pitman_yor.mix(np.arange(n, dtype=np.uint64) + np.uint64(sweep * n)), moves)
        assert len(sizes) == tables.sum() and sizes.min() >= 1
        assert (np.bincount(np.repeat(np.arange(n), tables), sizes) == c).all()
    np.testing.assert_allclose(np.bincount(tables, minlength=c + 1)[1:] / n, table_chances(c, parent, others, d, s), atol=0.015)


def test_gibbs_of_dishes_of_many_sizes():
    rng = np.random.default_rng(5)
    counts = rng.integers(2, 400, 500)
    seeds = pitman_yor.mix(np.arange(500, dtype=np.uint64))
    tables = pitman_yor.seat(counts, np.full(500, 0.1), np.full(500, 20), 0.7, 1.0, seeds)
    sizes = pitman_yor.start_sizes(counts, tables, 0.7, seeds)
    for _ in range(3):
        assert sizes.min() >= 1 and (np.bincount(np.repeat(np.arange(500), tables), sizes) == counts).all()
        sizes, tables = pitman_yor.gibbs(counts, sizes, tables, np.full(500, 0.1), np.full(500, 20), 0.7, 1.0, seeds)


@pytest.mark.parametrize("c, parent, others, d, s", [(2, 0.2, 0, 0.5, 1.0), (9, 0.05, 30, 0.8, 1.0), (60, 0.1, 40, 0.7, 1.0), (120, 0.02, 2000, 0.8, 1.0)])
def test_one_sweep_seats_all_customers_anew(c, parent, others, d, s):
    n = 20_000
    got = pitman_yor.reseat(np.full(n, c), np.full(n, parent), np.full(n, others), d, s, pitman_yor.mix(np.arange(n, dtype=np.uint64)))
    np.testing.assert_allclose(np.bincount(got, minlength=c + 1)[1:] / n, table_chances(c, parent, others, d, s), atol=0.015)


def test_dishes_of_many_customers_are_seated_as_by_the_recurrence(monkeypatch):
    rng = np.random.default_rng(8)
    counts = np.concatenate([[0, 1, 2, 3], rng.integers(2049, 3500, 120)])
    parent, others, seeds = 10 ** rng.uniform(-6, -0.01, 124), (10 ** rng.uniform(0, 7, 124)).astype(int), pitman_yor.mix(np.arange(124, dtype=np.uint64))
    for d in (0.05, 0.5, 0.8, 0.95):
        got = pitman_yor.reseat(counts, parent, others, d, 1.0, seeds)
        monkeypatch.setattr(pitman_yor, "RECURRED", 4000)
        np.testing.assert_array_equal(got, pitman_yor.reseat(counts, parent, others, d, 1.0, seeds))
        monkeypatch.undo()
    huge = pitman_yor.reseat(np.full(3, 10**8), np.array([1e-7, 1e-3, 0.5]), np.array([0, 10**6, 10**7]), 0.8, 1.0, seeds[:3])
    assert huge[0] == 1 and 1 < huge[1] < 10**4 and huge[2] < 10**8


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    c, t, p = rng.integers(0, 9, 50), np.zeros(50, int), rng.dirichlet(np.ones(50))
    t[c > 0] = rng.integers(1, c[c > 0] + 1)
    assert pitman_yor.predictive(c, t, pitman_yor.below(t.sum(), p, 0.6), c.sum(), 0.6).sum() == pytest.approx(1)


def test_seating_has_the_processs_mean():
    n, p, d, s = 12, 0.3, 0.5, 1.0
    got = pitman_yor.seat(np.full(20_000, n), np.full(20_000, p), np.zeros(20_000), d, s, pitman_yor.mix(np.arange(20_000, dtype=np.uint64)))
    rng = np.random.default_rng(1)
    want = []
    for _ in range(4000):
        t = 1
        for k in range(1, n):
            new = (s + d * t) * p
            t += rng.random() < new / (new + k - d * t)
        want.append(t)
    assert got.mean() == pytest.approx(np.mean(want), rel=0.03)
    assert got.min() >= 1 and got.max() <= n


def test_seating_of_many_customers_varies_as_the_process_does():
    n, p, o, d, s = 400, 0.02, 500, 0.7, 1.0
    got = pitman_yor.seat(np.full(4000, n), np.full(4000, p), np.full(4000, o), d, s, pitman_yor.mix(np.arange(4000, dtype=np.uint64)))
    rng, want = np.random.default_rng(1), np.ones(4000)
    for k in range(1, n):
        new = (s + d * (o + want)) * p
        want += rng.random(4000) < new / (new + k - d * want)
    assert got.mean() == pytest.approx(want.mean(), rel=0.03) and got.std() == pytest.approx(want.std(), rel=0.08)


def test_openings_are_binomial():
    seeds = pitman_yor.mix(np.arange(40_000, dtype=np.uint64))
    for n, chance in ((4, 0.3), (50, 0.97), (1000, 0.4), (7, 1.0), (7, 0.0)):
        got = pitman_yor.openings(np.full(40_000, n), np.full(40_000, chance), seeds, 9)
        assert got.min() >= 0 and got.max() <= n and got.mean() == pytest.approx(n * chance, rel=0.02)
        assert got.std() == pytest.approx((n * chance * (1 - chance)) ** 0.5, rel=0.03)


def test_the_first_sweeps_are_left_out():
    assert pitman_yor.BURN_IN >= 1 and pitman_yor.SAMPLES > 2


def test_features_of_words():
    row, begin, end, slots, _ = toxicity.word_features(pa.array(["Abcde fg", None, "abcdE"]), fold=True)
    assert row.tolist() == [0, 0, 2] and slots.shape == (3, 4)
    assert (slots[0] == slots[2]).all() and (slots[0] != slots[1]).any()
