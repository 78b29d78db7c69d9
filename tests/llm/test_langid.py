from __future__ import annotations

import math
import random
import unicodedata
import zlib

import numpy as np
import pytest

from lantern.llm import langid


@pytest.fixture(scope="module")
def model(small):
    return langid.train(small.where(~langid.held_out()))


def test_held_out_accuracy(spark, small):
    rows = langid.identify_documents(small).join(small.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == small.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    hidden = [r for r in rows if r["held_out"]]
    assert len(hidden) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in hidden]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixture_proportions(model, small):
    texts = {r["lang"]: r["text"] for r in small.where("length(text) between 2000 and 6000").collect()}
    a, b = texts["de"][:2000], texts["fr"][:1000]
    lang, score, n, explained = model.predict(a + " " + b)
    assert (lang, n, explained) == ("de", 2, True) and 0.55 < score < 0.8
    assert model.predict(a)[0] == "de" and model.predict(b)[0] == "fr"


def test_single_language_shortcut_agrees_with_iteration(model, small):
    """Where the bound says that no mixture pays, fitting every pair indeed gains too little."""
    for r in small.limit(25).collect():
        found, n = langid.grams(r["text"])
        n, p = n.astype(np.float32), model.p[found]
        total, single = float(n.sum()), n @ model.log_p[found]
        best = int(np.argmax(single))
        if model.predict(r["text"])[2] == 1:
            gains = [model._fit(p[:, [best, k]], n, total)[1] - single[best] for k in range(len(model.languages)) if k != best]
            assert max(gains) <= langid.PENALTY * np.log(total + 1) + 0.05


def test_grams_of_long_texts_are_whole(monkeypatch):
    text = "abc déf ghi " * 500
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "SLAB", 1000)
    cut = langid.grams(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_edges(edge_docs, no_docs):
    rows = langid.identify_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    unknown = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {20, 21, 22} <= unknown and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    left = langid.reject(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count() - 4
    assert langid.identify_documents(no_docs).count() == 0 and langid.reject(no_docs).count() == 0
    assert langid.Model({}).predict("text") == ("und", 0.0, 0, True)


def plain_grams(text):
    words = " " + " ".join("".join(c if c == "_" or (c.isalnum() and not c.isdecimal()) else " " for c in text.lower()).replace("_", " ").split()) + " "
    out = {}
    for a, b, c in zip(words, words[1:], words[2:], strict=False):
        h = ((ord(a) * 0x9E3779B1 + ord(b)) * 0x85EBCA6B + ord(c)) * 0x9E3779B97F4A7C15 % 2**64 >> 48
        out[h] = out.get(h, 0) + 1
    return out


def test_the_query_against_plain_em(spark, small):
    """Counts, likelihoods and iterations anew, in plain Python, for every row of the query."""
    from lantern.llm import queries

    docs = small.select("doc_id", "text", "lang").collect()
    kept = [r for r in docs if r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None]
    langs = sorted({r["lang"] for r in kept})
    counts = {x: {} for x in langs}
    for r in kept:
        for g, n in plain_grams(r["text"]).items():
            counts[r["lang"]][g] = counts[r["lang"]].get(g, 0) + n
    size = {x: sum(c.values()) + 65536 * langid.SMOOTHING for x, c in counts.items()}
    p = lambda g, x: (counts[x].get(g, 0) + langid.SMOOTHING) / size[x]

    def em(gs, chosen):
        n, table = np.array([*gs.values()], float), np.array([[p(g, x) for x in chosen] for g in gs])
        w = np.full(len(chosen), 1 / len(chosen))
        for _ in range(200 if len(chosen) > 1 else 1):
            w = w * ((n / (table @ w)) @ table)
            w /= w.sum()
        return w, float(n @ np.log(table @ w))

    for r in queries.op1_language_id(spark, "/root/testdata/sf0.001").collect():
        text = next(x["text"] for x in docs if x["doc_id"] == r["doc_id"])
        if not text or not any(unicodedata.category(c).startswith("L") for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        gs = plain_grams(text)
        total = sum(gs.values())
        chosen = [max(langs, key=lambda x: em(gs, [x])[1])]
        w, likelihood = em(gs, chosen)
        while len(chosen) < len(langs):
            tries = {x: em(gs, [*chosen, x]) for x in langs if x not in chosen}
            best = max(tries, key=lambda x: tries[x][1])
            if tries[best][1] - likelihood <= langid.PENALTY * math.log(total + 1):
                break
            chosen, (w, likelihood) = [*chosen, best], tries[best]
        top = max(range(len(chosen)), key=lambda k: w[k])
        assert (r["lang_pred"], r["n_languages"]) == (chosen[top], len(chosen)) and abs(r["score"] - w[top]) < 0.02


def test_letters_are_of_category_l(spark):
    signs = "²½Ⅷ①٣_7〇ª"
    for c in signs + "aßÉ世ʰǅ":
        assert langid.has_letter(f"12 {c}!") == unicodedata.category(c).startswith("L")
    rows = [(1, "² ½ Ⅷ ①", "en"), (2, "the word", "en"), (3, "12 _ 3", "en")]
    got = langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "und", 2: "en", 3: "und"}


def test_every_language_is_learned(spark):
    """More languages than a sample's even share has rows for, and marks at the far end of long texts."""
    r = random.Random(3)
    rows = []
    for k in range(90):
        letters = "".join(r.sample("abcdefghijklmnopqrstuvwxyz", 7))
        for d in range(8):
            rows.append((100 * k + d, "zzz " * 2000 + " ".join("".join(r.choices(letters, k=5)) for _ in range(300)), f"l{k:02}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = langid.train(df)
    assert len(model.languages) == 90
    assert all(model.predict(t[8000:])[0] == lang for _, t, lang in rows[::8])


def test_texts_that_no_language_explains_go(spark, model, small):
    assert langid.reject(small).count() == small.where("text is not null").count()
    r = random.Random(5)
    other = " ".join("".join(r.choices("ќџѓљњђћ", k=6)) for _ in range(100))
    assert not model.predict(other)[3] and model.predict(other[:90])[3]
    schema = "doc_id long, text string, lang string"
    strange = spark.createDataFrame([(1, other, None)], schema)
    left = langid.reject(small.select("doc_id", "text", "lang").unionByName(strange)).count()
    assert left == small.count()
    # Nothing to learn from: only texts without a letter go.
    none = spark.createDataFrame([(1, other, None), (2, None, None), (3, "12", None)], schema)
    assert [x["doc_id"] for x in langid.reject(none).collect()] == [1]
