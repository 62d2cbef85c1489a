"""Operators on single documents and pages: packing, mixing, media, extraction."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from labelcube.llm import html, media, mixing, packing

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "it's 3.5% — naïve, don't! &&& <|endoftext|> ÄÖ ÉTÉ, x,y;z"), (None, "hello"), (5, "word " * 5000), (5, "word " * 5000), (6, "zürich. ok, 'll 's we'll ...end...")]


@pytest.fixture(scope="module")
def tokenizer():
    """As the contract has it: by default strings of special tokens give their ids."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_words_give_the_tokenizers_ids(tokenizer, sample):
    known = packing.WordIds(packing.tokenizer_path(), remembered=200)  # so few that it forgets
    odd = ["foo <|endoftext|> bar", "x<|startoftext|>y. <|EndOfText|>. <|z", "\u039f\u03a3 \u03a3.", "stra\u00dfe \ufb01 \u1e9e", "a\u00a0b\u2003c", "w" * 500 + ". " + "\u00e9" * 40, "\u00b5 \u00aa\u00ba. \u00f7\u00df!"]
    texts = [t or "" for _, t in ODD] + odd + [r["text"] for r in sample.limit(60).collect()]
    for i in range(0, len(texts), 10):
        ids, at = known.of(pa.array(texts[i : i + 10]))
        for k, t in enumerate(texts[i : i + 10]):
            assert ids[at[k] : at[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], t


def test_words_of_one_hash_are_told_apart(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "mix", lambda x: x & np.uint64(7))
    text = "one two three four five six seven eight nine ten eleven twelve one two"
    ids, _ = packing.WordIds(packing.tokenizer_path()).of(pa.array([text]))
    assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def check_packing(rows, capacity):
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= capacity


def test_packing(docs, tokenizer):
    got = packing.packed(docs(ODD)).toPandas()
    check_packing(got, 2048)
    want = []
    for i, t in ODD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    have = [tuple(None if pd.isna(x) else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert packing.packed(docs([])).count() == 0


def test_odd_texts_have_the_contracts_ids(docs, tokenizer):
    odd = ["abc\x01.", "abc\x7f!", "J\u030c J\u030c. \u0130x", "a1. b2!? \u00e9. \u0663. x_.", "It's don't. DON'T!", "x\u0301. \u2167."]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.token_pieces(docs(list(enumerate(odd))), packing.tokenizer_path()).collect()}
    for i, t in enumerate(odd):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<i4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), t


def best_fit_decreasing(lengths, capacity):
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_a_sweep_over_ranges_is_best_fit_of_one_piece_a_gap(seed):
    rng = random.Random(seed)
    items = sorted([(rng.randint(1, 12), rng.randint(0, 1)) for _ in range(rng.randint(0, 60))], key=lambda x: (-x[0], x[1]))
    left, want = [k for k, (_, kind) in enumerate(items) if kind == 0], {}
    for k, (size, kind) in enumerate(items):
        fits = [g for g in left if items[g][0] >= size]
        if kind == 1 and fits:
            want[k] = items[min(fits, key=lambda g: items[g][0])][0]
            left.remove(max(g for g in fits if items[g][0] == want[k]))
    cuts = sorted(rng.choices(range(len(items) + 1), k=3))
    got, over, names = {}, [], {}
    for r, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(items)])):
        opener = packing.nested(np.array([kind == 0 for _, kind in items[a:b]], bool))
        got |= {a + k: items[a + o][0] for k, o in enumerate(opener) if o >= 0}
        pieces = [a + k for k in range(b - a) if items[a + k][1] and opener[k] < 0]
        gaps = [a + k for k in range(b - a) if not items[a + k][1] and k not in set(opener.tolist())]
        names[r] = pieces, gaps
        over.append((r, len(pieces), len(gaps)))
    for r, at, other, last, n in packing.carried(over):
        got |= {names[r][0][at + i]: items[names[other][1][last - i]][0] for i in range(n)}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_packing_needs_hardly_more_sequences_than_best_fit(spark, seed, monkeypatch, tmp_path):
    rng = random.Random(seed)
    monkeypatch.setattr(packing, "RANGE_ROWS", 60)
    lengths = [rng.choice([rng.randint(1, 100), 40, 100][: rng.choice([1, 3])]) for _ in range(rng.randint(50, 300))]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "name long, length long")
    got = packing.pack(pieces, packing.Scratch(spark, "test"), 100).toPandas()
    assert sorted(got.name) == list(range(len(lengths)))
    check_packing(got, 100)
    assert got.sequence_id.nunique() <= 1.02 * best_fit_decreasing(lengths, 100) + 1
    assert packing.pack(pieces.limit(0), packing.Scratch(spark, "test"), 100).count() == 0


def test_gaps_offer_no_more_slots_than_pieces_reach(spark, monkeypatch):
    sweep, offers, seen = packing.sweep, getattr(packing, "offers", None), []
    monkeypatch.setattr(packing, "sweep", lambda items: seen.append({r["kind"]: r["count"] for r in items.groupBy("kind").count().collect()}) or sweep(items))
    pieces = spark.createDataFrame([(k, 60 if k < 300 else 2) for k in range(305)], "key long, length long")
    got = packing.assign(pieces, packing.Scratch(spark, "test"), 100).toPandas()
    assert sorted(got.key) == list(range(305)) and got.seq.nunique() == 300
    assert [x[1] for x in seen] == [300, 5] and max(x[0] for x in seen) <= 305  # 20 slots each of 300 gaps before
    monkeypatch.setattr(packing, "offers", lambda sequences, gaps, least, longest, pieces: offers(sequences, gaps, least, longest, 10**9))
    rng = random.Random(0)
    lengths = [rng.choice([rng.randint(50, 90), rng.randint(1, 100), rng.randint(1, 9)][: rng.choice([1, 1, 2, 3])]) for _ in range(400)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, length long").repartition(3)
    every = packing.assign(pieces, packing.Scratch(spark, "test"), 100).toPandas()
    assert sum(x.get(0, 0) for x in seen[2:]) > 2 * len(lengths)
    monkeypatch.setattr(packing, "offers", offers)
    some = packing.assign(pieces, packing.Scratch(spark, "test"), 100).toPandas()
    pd.testing.assert_frame_equal(*(x.sort_values("key").reset_index(drop=True) for x in (some, every)))


def test_mixing_matches_sql(docs, words):
    rng = random.Random(3)
    table = [(i, words(rng.randint(0, 40), i)) for i in range(300)] + [(1000, None)]
    frame = docs(table, source=lambda k: "big" if k < 200 else f"small{k % 7}" if k < 299 else None)
    documents = frame.toPandas()
    want = duckdb.sql(mixing.sql()).df()
    got = mixing.mix_sources(frame).toPandas()
    columns = ["doc_id", "source", "epoch", "block", "start", "n_tokens", "weight"]
    key = ["source", "epoch", "start", "doc_id"]
    pd.testing.assert_frame_equal(got[columns].sort_values(key).reset_index(drop=True), want[columns].sort_values(key).reset_index(drop=True), check_dtype=False)
    assert documents.source.isna().sum() == 2
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    assert share["big"] < documents[documents.source == "big"].text.str.split().str.len().sum() / documents.text.fillna("").str.split().str.len().sum()


def test_mixing_stays_within_its_targets(docs, words):
    frame = docs([(i, words(10, i)) for i in range(110)], source=lambda k: "a" if k < 100 else "b")
    got = mixing.mix_sources(frame, entropy=2.0, repetition=3.0).toPandas()
    assert got[got.source == "b"].epoch.max() <= 2 and got[got.source == "b"].n_tokens.sum() <= 300
    natural = mixing.mix_sources(frame, entropy=0.0, repetition=1.0)
    assert natural.count() == pytest.approx(110, abs=2)
    assert mixing.mix_sources(docs([])).count() == 0
    assert mixing.mixed_rows(frame).columns == frame.columns


def test_deeper_blocks_give_the_same_order(docs, words, monkeypatch):
    frame = docs([(i, words(5 + i % 3, i)) for i in range(80)])
    want = sorted((r["doc_id"], r["epoch"], r["start"]) for r in mixing.mix_sources(frame).collect())
    monkeypatch.setattr(mixing, "FAN", 4)
    assert sorted((r["doc_id"], r["epoch"], r["start"]) for r in mixing.mix_sources(frame).collect()) == want


def test_stored_texts_come_back(docs):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.stored_texts(docs(ODD)).collect()}
    for i, t in ODD:
        own = (t or "").encode()
        payload = own.ljust(max(192, -(-len(own) // 192) * 192), b" ")
        r = got[i, hashlib.sha256(payload).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(own), len(payload), zlib.crc32(payload[-16:]))
        assert r["feature"].startswith("1536x") and r["media_bytes"] > 0
    assert media.stored_texts(docs([])).count() == 0


def test_any_bytes_round_trip():
    rng = np.random.default_rng(1)
    payloads = [bytes(rng.integers(0, 256, 192 * n, np.uint8)) for n in (1, 2, 9, 8191, 8193)] + [bytes([0, 255] * 96), bytes([255] * 384)]
    back = media.thumbnails(media.encode_payloads(payloads))
    assert [b"".join(t.tobytes() for _, _, t in images) for images in back] == payloads
    assert [len(images) for images in back][3:5] == [1, 2]
    good = media.encode_payloads([payloads[0]])[0]
    assert media.thumbnails([good + b"more\0"])[0][0][2].tobytes() == payloads[0]
    assert media.thumbnails([b"", b"no image", good[:-30], good, good[:200] + good[204:]])[:3] == [None] * 3


def colour_image(rng, mcus):
    """A baseline image of three components, the first sampled twice as finely, without restart markers; its first component's block means."""
    dc, ac = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)), bytes([0, 0, 0, 3] + [0] * 12) + bytes([0x00, 0x01, 0xF0])
    means, bits, before = [], "", [0, 0, 0]
    put = lambda v, size: "" if not size else format(v if v > 0 else v + (1 << size) - 1, f"0{size}b")
    for _ in range(mcus):
        for c, n in ((0, 4), (1, 1), (2, 1)):
            for _ in range(n):
                level = int(rng.integers(-100, 100))
                d = level - before[c]
                size = abs(d).bit_length()
                bits += format(size, "04b") + put(d, size)
                before[c] = level
                if c == 0:
                    means.append(level)
                if rng.random() < 0.5:
                    bits += "0001" + put(1, 1)
                bits += "0000"
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 16 * mcus, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac)
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9", np.array(means).reshape(mcus, 2, 2)


def test_other_baseline_images_are_read():
    rng = np.random.default_rng(2)
    image, means = colour_image(rng, 5)
    ((width, height, thumb),) = media.thumbnails([image])[0]
    assert (width, height) == (80, 16)
    assert (thumb.astype(int) - 128 == means.transpose(1, 0, 2).reshape(2, 10)).all()


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><div>Top offers today</div><article><h1>{0} &amp; Co</h1><p>{0}   one<br>two<script>var x='<p>';</script><div class='comments'>nice</div></article><div>Contact us</div><footer>&copy;</footer></body></html>"


def test_extraction(spark):
    bare = "<div>Home News</div><p>{}</p><div>Imprint of site</div>"
    pages = [(1, "http://a.com/x/1", PAGE.format("First")), (2, "http://a.com/x/2", PAGE.format("Second")), (3, "http://b.com/n/1", bare.format("Alpha")), (4, "http://b.com/n/2", bare.format("Beta")), (5, "http://b.com/n/2", bare.format("Beta")),
             (6, None, None), (7, "::", ""), (None, "http://c.com", "just text &lt;here"), (8, "http://d.com/1", "<p>" + "long " * 50_000 + "</p>"), (1, "http://a.com/x/1", PAGE.format("First"))]
    frame = spark.createDataFrame([(*p, "x", b"k") for p in pages], "page_id long, url string, html string, body string, key binary")
    got = {(r["page_id"], r["url"]): r for r in html.extract(frame).collect()}
    assert html.extract(frame).count() == len(pages)
    assert got[1, "http://a.com/x/1"]["text"] == "First & Co\nFirst one\ntwo"
    assert got[3, "http://b.com/n/1"]["text"] == "Alpha"
    assert got[4, "http://b.com/n/2"]["text"] == got[5, "http://b.com/n/2"]["text"] == "Beta"
    assert got[6, None]["text"] == got[7, "::"]["text"] == "" and got[6, None]["n_chars"] == 0
    assert got[None, "http://c.com"]["text"] == "just text <here"
    assert got[8, "http://d.com/1"]["n_chars"] == 5 * 50_000 - 1
    assert html.extract(frame.limit(0)).count() == 0


def test_marks_leave_article_text():
    def left(page):
        return html.main_text([[x.text, x.inside, x.outside] for x in html.page_lines(page)], set())

    for name in ("layout with-sidebar", "no-sidebar", "sidebar"):
        assert left(f"<body><div class='{name}'><div class='ad'>buy</div><article><p>text</p></article></div></body>") == "text"
    inner = "<h2 id='social-impact'>a</h2><section id='related-work'>b</section><p class='notice'>c</p><h2 id='search'>d</h2><p>e <math><mi>x</mi></math> <label>f</label></p>"
    assert left(f"<article>{inner}<div class='comments'>no</div><div class='big ad'>no</div></article>") == "a\nb\nc\nd\ne x f"
    assert left("<div id='menu'>no</div><p>yes</p><div class='cookie'>no</div>") == "yes"
    assert left("<article>text</article><div class='comments'><article>no</article></div>") == "text"


def test_odd_quotes_end_tags_where_browsers_do():
    def left(page):
        return html.main_text([[x.text, x.inside, x.outside] for x in html.page_lines(page)], set())

    assert left("""<p title="a"b">Hello</p><p data-x=it's>World</p><p a='x>y' b="<i>">!</p><a href=?a="b>c</a>""") == "Hello\nWorld\n!\nc"
    assert left("<article><section id='side-effects'><p>Nausea.</p></section><p class='search-algorithms'>Binary search</p><map>m</map></article>") == "Nausea.\nBinary search\nm"
    assert left("<p>a < b and c > d</p><p =x>y") == "a < b and c > d\ny"


def generated_host(rng, pages, article):
    """Pages of one host as (url, html, main text), with a template around and within, quotations, a reprint and a copy."""
    out, quote = [], "a sentence that many quote"
    top, low = ["Read more of us"], ["Tell your friends", "All rights reserved"]
    for k in range(pages):
        own = [f"title {k}", *(f"line {k} {j} {rng.random()}" for j in range(rng.randint(4, 9)))]
        if rng.random() < 0.5:
            own.insert(rng.randint(2, len(own) - 1), quote)
        if k == 5:
            own = [*out[4][2].split("\n"), "printed here first"]
        inner = "".join(f"<p>{x}</p>" for x in [*top, *own, *low])
        body = f"<article>{inner}</article>" if article else f"<div>{inner}</div>"
        out.append((f"http://h.com/{'news' if k % 2 else 'blog'}/{k}", f"<body><nav>Home</nav><div>Today {'' if article else 'on h.com'}</div>{body}<footer>x</footer></body>", "\n".join(own)))
    return [*out, (out[3][0] + "?again", out[3][1], out[3][2])]


@pytest.mark.parametrize("article", [True, False])
def test_templates_go_and_articles_stay(spark, article):
    rng = random.Random(8)
    pages = generated_host(rng, 80, article)
    frame = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(frame).collect()}
    wrong = [k for k, (_, _, text) in enumerate(pages) if got[k] != text]
    if article:  # a quotation stands among the page's own lines, and the template at the article's ends
        assert wrong == []
    else:  # without an article nothing tells a shared quotation from the template
        assert all(set(got[k].split("\n")) | {"a sentence that many quote"} == set(pages[k][2].split("\n")) | {"a sentence that many quote"} for k in range(len(pages)) if k not in (4, 5))


def test_pages_are_held_as_what_may_stay_of_them(spark):
    pages = ["", None, "<nav>" + "menu " * 500 + "</nav>", "<nav>home</nav><p>a &#233;</p><div class=ad>buy</div><p>b\n c</p>", "".join(f"<p>{k}</p>" for k in range(300)), "<p>beside</p><article><p>x</p><p>y</p></article>"]
    frame = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for r in html.parsed_pages(frame).collect():
        lines = [[x.text, x.inside, x.outside] for x in html.page_lines(pages[r["page_id"]] or "")]
        assert len(r["digests"]) == html._LINE * len(lines)
        for shared in (set(), {0, 1}, {len(lines) - 1}, set(range(len(lines)))):
            assert html.stored_text(r["may"], r["body"], shared) == html.main_text(lines, shared)
        if r["page_id"] == 2:
            assert html.stored_text(r["may"], r["body"], set()) == "" and len(r["body"]) < 20  # nothing of what markup drops


def test_pages_are_ordered_without_their_lines(spark, monkeypatch):
    rows = [(i, f"http://h/{i % 40:02}", f"<p>top</p><p>line {i % 40}</p>") for i in [*range(90), 3]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    written, write = {}, html.Scratch.write

    def noted(self, df, name):
        written[name] = write(self, df, name)
        return written[name]

    monkeypatch.setattr(html.Scratch, "write", noted)
    got = html.extract(frame).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((i, f"line {i % 40}") for i, _, _ in rows)
    assert "digests" in written["parsed"].columns and "digests" not in written["ordered"].columns


def test_template_lines_against_a_plain_version():
    def plain(own, near):
        def lcs(a, b):
            best = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + [i] if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j], key=len)
            return best[-1][-1]

        inside = [i for i, x in enumerate(own) if x[-1]]
        shared = [lcs([x[:-1] for x in own], [x[:-1] for x in other]) for other in near]
        found = next((c for c in shared if len(c) <= html.COPY * len(own)), shared[0] if shared else [])
        out = {i for i in found if i not in inside}
        for k, i in enumerate(inside):
            votes, asked = 0, 0
            for c, other in zip(shared, near):
                theirs = [x[:-1] for x in other if x[-1]]
                asked += sum(x in inside for x in c) <= html.REPRINT * len(inside)
                if sum(x in inside for x in c) <= html.REPRINT * len(inside) and i in c:
                    mine = [own[x][:-1] for x in inside]
                    votes += mine[: k + 1] == theirs[: k + 1] or mine[k:] == theirs[len(theirs) - len(mine[k:]) :] and len(theirs) >= len(mine[k:])
            if votes == asked >= html.AGREE:
                out.add(i)
        return sorted(out)

    rng = random.Random(9)
    for _ in range(200):  # distinct lines in one order, so that there is one longest common subsequence
        pages = [[bytes([65 + x, rng.choice([0, 1, 1]) if fuzzy else 1]) for x in sorted(rng.sample(range(20), rng.randint(0, 9)))] for fuzzy in [rng.random() < 0.5] for _ in range(5)]
        assert html.template_lines(pages[0], pages[1:]) == plain(pages[0], pages[1:])
    assert html.template_lines([b"a\1"], []) == []


def test_common_lines_are_a_longest_subsequence(monkeypatch):
    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(4)
    monkeypatch.setattr(html, "CELLS", 20)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcde", k=rng.randint(0, 14))) for _ in range(2))
        found = html.common_lines(list(a), list(b))
        rest = iter(b)
        assert all(a[i] in rest for i in found) and len(found) == longest(a, b) and found == sorted(set(found))
