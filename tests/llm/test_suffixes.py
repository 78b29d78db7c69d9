from __future__ import annotations

import hashlib
import random

import pytest

from lantern.llm import suffixes


def plain_repeats(texts, min_len):
    at = {}
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + min_len, len(x) + 1):
                at.setdefault(x[i:j], []).append((t, i))
    out = []
    for s, places in at.items():
        left = {texts[t][i - 1 : i] or (t,) for t, i in places}
        right = {texts[t][i + len(s) : i + len(s) + 1] or (t,) for t, i in places}
        if len(places) > 1 and len(left) > 1 and len(right) > 1:
            out.append((len(s), sorted(places)))
    return sorted(out)


def test_maximal_repeats_against_all_substrings(monkeypatch):
    r = random.Random(1)
    for _ in range(60):
        letters = r.choice([b"ab", b"abcd", b"a", b"a\0"])
        texts = [bytes(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        n = r.choice([3, 5, 8])
        monkeypatch.setattr(suffixes, "ROUNDS", r.choice([0, 1, 2, 64]))
        assert sorted(suffixes.maximal_repeats(texts, n)) == plain_repeats(texts, n)


def plain_removal(rows, n):
    """Rows (doc_id, text) in order of doc_id -> what is left, and which bytes go."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1):
            w = data[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        out[d] = (bytes(b for b, g in zip(data, gone, strict=True) if not g), gone)
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    base = "".join(r.choice("abcde ") for _ in range(700))
    rows = []
    for d in range(n):
        c = r.random()
        if c < 0.25:
            t = base
        elif c < 0.55:
            t = list(base)
            for _ in range(r.randint(1, 6)):
                t[r.randrange(len(t))] = r.choice("ZY")
            t = "".join(t)
        elif c < 0.75:
            i = r.randrange(500)
            t = "".join(r.choice("xyz") for _ in range(80)) + base[i : i + 150] + "q" * r.randint(0, 60)
        elif c < 0.82:
            t = "ab" * r.randint(0, 300)
        elif c < 0.9:
            t = base[: r.randint(0, 120)] * 3
        elif c < 0.95:
            t = "é" * r.randint(0, 300)
        else:
            t = r.choice([None, "", "short"])
        rows.append((d, t))
    return rows


def check_rows(got, rows, want):
    assert len(got) == len(rows)
    for r in got:
        left, gone = want[r["doc_id"]]
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(gone), sum(gone), spans)
        assert r["kept_sha256"] == hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize(("open_max", "anchor_bytes"), [(suffixes.OPEN_MAX, suffixes.ANCHOR_BYTES), (3, suffixes.ANCHOR_BYTES), (suffixes.OPEN_MAX, 150), (2, 1)])
def test_removal_against_plain_code(spark, open_max, anchor_bytes):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_rows(suffixes.remove_repeats(df, open_max=open_max, anchor_bytes=anchor_bytes).collect(), rows, plain_removal(rows, 100))


def steps(rows, batch, open_max=suffixes.OPEN_MAX, anchor_bytes=suffixes.ANCHOR_BYTES):
    """The steps in one process, the rows sorted as the shuffles would -> what goes of each (doc, t1, t2)."""
    import pandas as pd

    def cut(df, n):
        return iter([df[k : k + n].reset_index(drop=True) for k in range(0, len(df), n)])

    document = suffixes.DOCUMENT
    df = pd.DataFrame([(d, t1, t2, t or "") for d, t1, t2, t in rows], columns=[*document, "text"])
    by_anchor = pd.concat(suffixes._rows_by_anchor(100, 32)(cut(df, 6))).sort_values(["a", "v", *document, "at"])
    met = pd.concat(suffixes._meet(100, open_max, anchor_bytes)(cut(by_anchor, batch)))
    gone = {(d, t1, t2): bytearray(len((t or "").encode())) for d, t1, t2, t in rows}
    for x in met[met.kind == suffixes.REPEAT].itertuples():
        gone[x.doc, x.t1, x.t2][x.s : x.e] = b"\1" * (x.e - x.s)
    told = met[met.kind != suffixes.REPEAT]
    asked = {k: g[["kind", "a", "s", "e", "others"]].to_dict("records") for k, g in told.groupby(document)}
    docs = df[[k in asked for k in df[document].itertuples(index=False, name=None)]]
    docs = docs.assign(asked=[asked[k] for k in docs[document].itertuples(index=False, name=None)])
    if len(docs):
        segments = pd.concat(suffixes._cut(100)(cut(docs, 4))).sort_values(["a", *document, "s"])
        for out in suffixes._scan(100)(cut(segments, batch)):
            for x in out.itertuples():
                gone[x.doc, x.t1, x.t2][x.s : x.e] = b"\1" * (x.e - x.s)
    return gone, met


@pytest.mark.parametrize(("slab", "batch"), [(1, 50), (64, 7), (1000, 50)])
def test_documents_longer_than_a_slab(monkeypatch, slab, batch):
    monkeypatch.setattr(suffixes, "SLAB", slab)
    monkeypatch.setattr(suffixes, "PIECE", slab)
    monkeypatch.setattr(suffixes, "BATCH", 500)
    rows = [(k, t) for k, t in corpus(5, 14)]
    want = plain_removal(rows, 100)
    for limits in ((16384, 1 << 20), (5, 1 << 20), (16384, 300)) if slab > 1 else ((5, 300),):
        for places in (128, 2) if slab > 1 else (2,):
            monkeypatch.setattr(suffixes, "PLACES_MAX", places)
            gone, _ = steps([(d, 0, 0, t) for d, t in rows], batch, *limits)
            assert gone == {(d, 0, 0): g for d, (_, g) in want.items()}


def test_places_of_a_segment_are_bounded(monkeypatch):
    """Many copies of one text, each in a slab of its own: no document is asked for more than a few."""
    monkeypatch.setattr(suffixes, "SLAB", 1)
    monkeypatch.setattr(suffixes, "PLACES_MAX", 5)
    text = "".join(random.Random(3).choices("abcdefgh ", k=300))
    gone, met = steps([(d, 0, 0, text) for d in range(50)], 64)
    assert {k: sum(g) for k, g in gone.items()} == {(d, 0, 0): 300 * (d > 0) for d in range(50)}
    asked = met[met.kind != suffixes.REPEAT]
    assert asked["others"].dropna().map(len).max() == 5 * 32 and asked["doc"].nunique() == 9


def test_one_hot_anchor():
    """A passage in every document, behind a word of each document's own: one anchor, as many kinds of run."""
    r = random.Random(4)
    passage = "the same words stand here in every text of the table, "
    rows = [(k, f"{r.random()} " + passage + "".join(r.choice("pqrs") for _ in range(6)) + passage[::-1] + str(k)) for k in range(150)]
    want = plain_removal(rows, 100)
    for limits in ((16384, 1 << 20), (16384, 4000), (40, 1 << 20)):
        gone, met = steps([(d, 0, 0, t) for d, t in rows], 64, *limits)
        assert gone == {(d, 0, 0): g for d, (_, g) in want.items()}
        assert (met.kind == suffixes.STRINGS).any() == (limits != (16384, 1 << 20))


def test_documents_that_share_an_id():
    """One doc_id, and even one half of the hash: texts that differ are different documents."""
    text = "".join(random.Random(2).choices("abcdefgh ", k=400))
    rows = [(7, 1, 5, text), (7, 1, 3, text + "!"), (7, 1, 5, text), (8, 1, 3, text)]
    gone, _ = steps(rows, 50)
    assert {k: sum(g) for k, g in gone.items()} == {(7, 1, 3): 0, (7, 1, 5): 400, (8, 1, 3): 400}


def test_every_removed_byte_comes_from_a_group(monkeypatch):
    """Without the interval tree's groups nothing is removed but what a segment's own places say."""
    rows = [(d, 0, 0, t) for d, t in corpus(3)]
    full, _ = steps(rows, 50)
    monkeypatch.setattr(suffixes, "later_spans", lambda *a, **k: suffixes._joined(a[1][:0], a[1]["s"][:0]))
    none, _ = steps(rows, 50)
    assert sum(map(sum, full.values())) > 0 and sum(map(sum, none.values())) == 0


def test_batches_of_the_scan(spark):
    """Documents longer than a slab and many small scan batches give the same removals."""
    rows = [(k, t) for k, t in enumerate(["xy" * 5000 + "abc" * 200, "abc" * 200 + "zz" * 10, "xy" * 5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_removal(rows, 100)
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(df).collect()} == {d: sum(g) for d, (_, g) in want.items()}


def test_edges(edge_docs, no_docs):
    rows = suffixes.remove_repeats(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    twins = [tuple(r) for r in rows if r["doc_id"] == 23]
    assert twins[0] == twins[1] and suffixes.remove_repeats(no_docs).count() == 0
    assert {r["n_bytes"] for r in rows if r["doc_id"] in (20, 21)} == {0}
    long = next(r for r in rows if r["doc_id"] == 25)
    assert long["n_bytes"] == 1_300_000 and long["n_bytes"] - long["n_removed"] == 5
    out = suffixes.without_repeats(edge_docs)
    assert out.columns == edge_docs.columns and out.dtypes == edge_docs.dtypes and out.count() == edge_docs.count()
    assert out.where("text is null").count() == 2 and suffixes.without_repeats(no_docs).count() == 0
    assert out.where("length(text) <> n_chars").count() == 0
