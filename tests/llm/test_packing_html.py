from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest

from lantern.llm import html, packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder.of(packing._default_model())


def test_ids_equal_the_tokenizer(encoder):
    r = random.Random(5)
    parts = ["a", "The", "é", "'s", "'", " ", "  ", "\n", "\n\n", "!", "##", "12", "don't", "ß", ".", "\t", "—", "日", "<|endoftext|>", "I'll", "_", "|", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for t, ids in zip(texts, encoder.batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_long_texts_go_in_portions(encoder, monkeypatch):
    from lantern.llm import pieces

    codec = pieces.Codec.of(pieces._default_model())
    r = random.Random(6)
    texts = ["".join(r.choice(["abc", " de", " ", "\n", "  x", "é", "1 ", "'s", " —", "<|endoftext|>"]) for _ in range(80)) for _ in range(60)] + [" " * 50, "a" * 90]
    for t in texts:
        monkeypatch.setattr(packing, "PORTION", 7)
        monkeypatch.setattr(pieces, "PORTION", 7)
        assert "".join(packing.portions(t)) == t
        assert np.frombuffer(encoder.batch([t])[0], "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode([t])[0][0], "<u4").tolist() == codec.other.encode(t)


def test_new_pre_tokens_go_one_text_a_call(encoder, monkeypatch):
    """Several texts in a call start threads, whose waiting took a quarter of the operator's CPU."""
    calls, inner = [], encoder.inner

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return inner.encode_batch_fast(texts, **options)

    monkeypatch.setattr(encoder, "inner", Counted())
    monkeypatch.setattr(encoder, "memo", {})
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q" for k in range(17_000))
    assert encoder.batch([text, "plain"]) == [encoder._ids(text), encoder._ids("plain")]
    assert len(calls) > 2 and set(calls) == {1}


def test_new_pre_tokens_share_lines(encoder, monkeypatch):
    """A line of its own for each pre-token costs the tokenizer more CPU; shared ones change no id."""
    lines, inner = [], encoder.inner

    class Counted:
        def encode_batch_fast(self, texts, **options):
            lines.extend(x for text in texts for x in text.split("\n"))
            return inner.encode_batch_fast(texts, **options)

    monkeypatch.setattr(encoder, "inner", Counted())
    monkeypatch.setattr(encoder, "memo", {})
    r = random.Random(8)
    kinds = "abehintäéñßÿ", "ABEHINTÄÉÑÀÞ", "0123456789", "!#'-._~"
    words = ["".join(r.choices(r.choice(kinds), k=r.randint(1, 9))) for _ in range(4000)]
    text = "".join(f" {w}" for w in words)
    assert encoder.batch([text]) == [encoder._ids(text)]
    assert len(encoder.memo) > 3000 and 0 < len(lines) < len(encoder.memo) / 8
    for w, ids in encoder.memo.items():
        assert ids == encoder._ids(w)


def check_packed(rows, texts, encoder, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for piece in by.values():
        at = 0
        for r in sorted(piece, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    for doc, text in texts.items():
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids) and [r["piece"] for r in mine] == list(range(len(mine)))
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert all(r["length"] == size for r in mine[1:])
    return len(by)


def test_round_trip_and_number_of_sequences(small, encoder):
    rows = packing.pack_documents(small).collect()
    n = check_packed(rows, {r["doc_id"]: r["text"] for r in small.collect()}, encoder, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_merge_rounds(spark):
    """Many shards, several rounds: still gapless, and nearly as few sequences as there can be."""
    r = random.Random(6)
    rows = [(k, 0, 0, n, k) for k, n in enumerate(r.choice([r.randint(1, 40), r.randint(1, 99), 60, 100]) for _ in range(4000))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, size=100, slack=0, shard_rows=100).collect()
    assert sorted((x["doc_id"], x["length"]) for x in got) == sorted((x[0], x[3]) for x in rows)
    ends = {}
    for x in got:
        ends.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for spans in ends.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 100
    one = len(set(packing.best_fit(sorted((x[3] for x in rows), reverse=True), 100)))
    assert len(ends) <= one * 1.02 + 2


def test_shards_stay_bounded():
    """The number of shards keeps each near shard_rows, and a round that cannot help is not begun."""
    for shards, rows, left in ((8, 300_000, 250_000), (100, 4_000_000, 2_000_000), (2, 60_000, 30_000), (1000, 40_000_000, 39_000_000), (3, 120_000, 0)):
        fewer = packing.merged_shards(shards, rows, left, 40_000)
        assert fewer is None or (fewer < shards and left <= fewer * 40_000)
    assert packing.merged_shards(100, 4_000_000, 2_000_000, 40_000) == 50
    assert packing.merged_shards(8, 320_000, 320_000, 40_000) is None and packing.merged_shards(8, 320_000, 0, 40_000) is None


def test_pieces_over_half_a_sequence_and_equal_rows(spark):
    """Pieces that never share a sequence stop after one round; equal rows spread over the shards."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    alone = spark.createDataFrame([(k, 0, 0, 60, k) for k in range(700)], schema)
    got = packing.pack(alone, size=100, slack=0, shard_rows=100).collect()
    assert len({x["sequence_id"] for x in got}) == 700
    equal = spark.range(900).selectExpr("CAST(NULL AS long) doc_id", "0 piece", "0L start", "1L length", "5L ids_crc32")
    got = packing.pack(equal, size=100, slack=0, shard_rows=100).collect()
    shards = {}
    for x in got:
        shards.setdefault(x["sequence_id"] >> 30, []).append(x)
    assert len(got) == 900 and len({x["sequence_id"] for x in got}) <= 14 and max(map(len, shards.values())) < 300


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert packing.best_fit([10, 10], 10) == [0, 1] and packing.best_fit([], 10) == []


def test_packing_edges(edge_docs, no_docs, encoder):
    rows = packing.pack_documents(edge_docs).collect()
    check_packed(rows, {r["doc_id"]: r["text"] for r in edge_docs.where("doc_id is not null and doc_id <> 23").collect()}, encoder, 2048)
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 23 for r in rows) == 2
    assert packing.pack_documents(no_docs).count() == 0


def test_blocks():
    page = (
        "<!-- <p>no</p> --><head><title>t</title><meta x></head><body class='a B2'><p>one <b>two</b>\n three<br>four&amp;five<p>next"
        "<script>var a='</p><p>no';</script><style>p{}</style><ul><li>i1<li>i2 <a href='/x>y'>link</a></ul><div id=main>tail < 5 &eacute;&#233;"
    )
    got = html.blocks(page)
    assert [b.text for b in got] == ["one two three four&five", "next", "i1", "i2 link", "tail < 5 éé"]
    assert [e[0] for e in got[3].path] == ["body", "ul", "li"] and got[0].path[0][:2] == ("body", "a") and got[3].linked == 4
    assert html.blocks("") == [] and html.blocks("<p") != [] and html.blocks("<script>never closed <p>x") == []


def test_heads_that_are_not_closed():
    for page, want in (
        ("<html><head><meta charset=x><p>Hello there dear reader", ["Hello there dear reader"]),
        ("<head><title>t</title>\n <link rel=x> plain words <p>more", ["plain words", "more"]),
        ("<head><title>t</title><script>x</script><div>in the body</div></head><p>after", ["in the body", "after"]),
        ("<head> <style>p{}</style> </head> <body>b", ["b"]),
    ):
        assert [b.text for b in html.blocks(page)] == want


def test_quotes():
    assert [b.text for b in html.blocks("<p title=don't>one<p class=\"a>b\">two<p x='>'>three")] == ["one", "two", "three"]
    assert [b.text for b in html.blocks('<p title="never closed>one<p>two <b>three')] == ["one", "two three"]
    got = html.blocks('<div class = "Main  text"><p id=x role=\'y\'>a')
    assert got[0].path == [("div", "main", "text"), ("p", "x", "y")]


@pytest.mark.parametrize("broken", [
    "<script ", "<a href=\"", "<a '", "<p x='y\"", "<b><div>", "<", "</ ", "<!", "<!-- ", "<p>" + "<b>" * 3, "<p><div><b><b><b><hr>", "<li><ul>", "<a =", "<?", "<td><p>", "<title ", "&amp",
])
def test_broken_pages_take_time_in_proportion(broken):
    """A megabyte of each; a quadratic reader would need hours."""
    page = "<article><p>Some words come first.</p>" + broken * (1_000_000 // len(broken))
    began = time.process_time()
    found = html.blocks(page)
    assert found[0].text == "Some words come first."
    if len(found) > 1:
        html.vectors(found[:20_000])
    html.blocks(page + ">")
    assert time.process_time() - began < 60


def test_long_pages_are_labelled_like_short_ones(labeller):
    r = random.Random(12)
    for _ in range(20):
        found = html.blocks(html.page_with_labels(r)[0])
        assert np.array_equal(labeller.label_long(found, 5), labeller.label([html.vectors(found)])[0])


def test_a_page_of_a_megabyte(spark, labeller):
    r = random.Random(3)
    paragraphs = [html._prose(r, 60).replace("&amp;", "&") for _ in range(4000)]
    page = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/>News</a></li></ul></nav><article><h1>Title of it</h1>" + "".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in paragraphs)
    page += "</article><footer><p>© 2024 All rights reserved</p></footer></body></html>"
    assert len(page) > 1 << 20
    row = html.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), labeller).first()
    assert row["text"] == "\n\n".join(["Title of it", *paragraphs])


@pytest.mark.parametrize("opening", ['<div class="content">', '<div id="main">', "<main>", "<section class=post>", '<div class="entry story">'])
def test_main_text_that_is_not_in_an_article(labeller, opening):
    """Pages put down by hand, with their texts; no article element anywhere."""
    close = "</" + opening[1:].split()[0].rstrip(">") + ">"
    text = [
        "A walk along the old canal", "The path begins behind the station and follows the water for about six miles.",
        "Herons stand in the reeds in the morning, and few people come by before ten.", "After the second lock the path turns away from the road & into the woods.",
    ]
    page = (
        '<html><head><title>x</title></head><body><div class="cookie-notice">We use cookies to improve your visit. <button>Accept</button></div>'
        '<header><div>Canal Walks</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li><li><a href="/c">Contact</a></li></ul></nav>'
        f"{opening}<h1>{text[0]}</h1><p>{text[1]}</p><p>{text[2]}</p><p>{text[3].replace('&', '&amp;')}</p>{close}"
        '<aside class="sidebar"><h3>Related posts</h3><ul><li><a href="/d">Ten more walks</a></li></ul></aside><div class="comments"><p>Great read, thanks!</p><p>Reply</p></div>'
        '<form class="newsletter"><label>Email address</label><button>Subscribe</button></form><footer><p>© 2024 All rights reserved</p></footer><script>var a = 1;</script></body></html>'
    )
    assert html.main_text([page], labeller) == ["\n\n".join(text)]


@pytest.fixture(scope="module")
def labeller():
    return html.trained()


def test_labeller_on_new_pages(labeller):
    r = random.Random(77)
    wrong = total = 0
    for _ in range(150):
        page, article = html.page_with_labels(r)
        found = html.blocks(page)
        marks = labeller.label([html.vectors(found)])[0]
        wrong += sum(m != (b.text in article) for m, b in zip(marks, found, strict=True))
        total += len(found)
    assert wrong < 0.01 * total


def test_gradient(labeller):
    """The way back through both LSTMs against finite differences."""
    net = html.Labeller(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(1)
    pages = [r.normal(0, 1, (n, html.INPUT)) for n in (3, 5)]
    labels = [np.array([1, 0, 1.0]), np.array([0, 0, 1, 1, 0.0])]

    def loss():
        logit = net.forward(pages)[-1]
        return sum(np.logaddexp(0, -(2 * y - 1) * logit[: len(y), k]).sum() for k, y in enumerate(labels))

    x, y, turn, cols, both, tape_f, tape_b, logit = net.forward(pages)
    grad = np.zeros_like(logit)
    for k, t in enumerate(labels):
        grad[: len(t), k] = html._sigmoid(logit[: len(t), k]) - t
    d = grad[..., None] * net.w["o"]
    got = net._back(x, "f", tape_f, d[..., : html.HIDDEN]) | net._back(y, "b", tape_b, d[..., html.HIDDEN :][turn, cols])
    for name, at in (("xf", (5, 7)), ("hf", (2, 40)), ("bb", (20,)), ("xb", (9, 33)), ("hb", (1, 3))):
        old, e = net.w[name][at], 1e-3
        net.w[name][at] = old + e
        up = loss()
        net.w[name][at] = old - e
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / (2 * e) - got[name][at]) < 2e-3 * max(1, abs(got[name][at]))


def test_extraction_edges(spark, labeller):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<nav><ul><li><a href=/>Home</a></li></ul></nav>", "x"), (3, "u", "<article><h1>Head</h1><p>" + "word " * 5000 + "</p></article>", "x")]
    rows += [rows[3], (4, "u", "plain text without any tag at all, one sentence.", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df, labeller).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[None] == by[2] == "" and by[3] == "Head\n\n" + ("word " * 5000).strip()
    assert html.extract(df.limit(0), labeller).count() == 0


def test_pages_of_the_table(spark, labeller):
    """On these pages the article element bounds the main text."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r, text in zip(rows, html.main_text([r["html"] for r in rows], labeller), strict=True):
        inner = r["html"][r["html"].index("<article>") : r["html"].rindex("</article>")]
        assert text == "\n\n".join(b.text for b in html.blocks(inner))
