from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from lantern.llm import simhash
from tests.llm.test_simhash import classes, plain_fingerprint


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Twelve texts of 200 words, each with copies of 1 to 4 and of 6 exchanged words."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    texts = {}
    for k in range(12):
        own = [r.choice(words) for _ in range(200)]
        texts[10 * k] = " ".join(own)
        for e in (1, 2, 3, 4, 6):
            copy = list(own)
            for at in range(10, 10 + 20 * e, 20):
                copy[at] = f"new{k}x{e}x{at}"
            texts[10 * k + e] = " ".join(copy)
    return texts


def test_planted_copies_go(spark):
    texts = planted()
    sets = {d: shingles(t) for d, t in texts.items()}
    fps = {d: plain_fingerprint(t, 5) for d, t in texts.items()}
    keys = sorted(texts)
    pairs = [(a, b, jaccard(sets[a], sets[b])) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    far = [j for a, b, j in pairs if 0.8 <= j <= 0.96 and (fps[a] ^ fps[b]).bit_count() > 3]
    assert len(far) > 40  # the fingerprints alone do not see them
    want = classes([(a, b) for a, b, j in pairs if j >= 0.8 or (fps[a] ^ fps[b]).bit_count() <= 3], keys)
    docs = spark.createDataFrame([(d, t, "en", "s0", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))
    assert len({d for d in keys if d % 10 == 6} & set(want.values())) > 6  # copies under 0.8 stay


def test_alike_and_samples(monkeypatch):
    texts = [*planted().values()][:12] + ["", " ", "one", "one two three four", "a b c " * 50]
    for a in texts:
        fp, tables = simhash.sampled(a, 5)
        assert fp % 2**64 == plain_fingerprint(a, 5) and len(tables) == (simhash.TABLES if a.split() else 0)
        for b in texts:
            x, y = simhash.shingle_set(a, 5), simhash.shingle_set(b, 5)
            if len(x) and len(y):
                s = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
                assert simhash.alike(x, y, 0.8) == (s >= 0.8)
    whole = [(simhash.sampled(t, 5), simhash.shingle_set(t, 5).tobytes()) for t in texts]
    monkeypatch.setattr(simhash, "SLAB", 16)
    assert whole == [(simhash.sampled(t, 5), simhash.shingle_set(t, 5).tobytes()) for t in texts]


def test_lists_without_a_common_text(spark, monkeypatch):
    """A chain in which each text is like its neighbours alone, all under one key: several rounds of
    hubs, the comparisons of each in parts, and the links of all pairs."""
    monkeypatch.setattr(simhash, "HUB_PAIRS", 3)
    monkeypatch.setattr(simhash, "HUBS_GROW", 2)
    r = random.Random(7)
    own = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = {}
    for k in range(40):
        if k % 10 == 0:  # four chains that have nothing to do with each other
            own = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for at in range((k % 10) * 18, (k % 10) * 18 + 18, 9):
            own[at] = f"new{k}x{at}"
        texts[k] = " ".join(own)
    sets = {d: shingles(t) for d, t in texts.items()}
    want = classes([(a, b) for a in texts for b in texts if a < b and jaccard(sets[a], sets[b]) >= 0.8], sorted(texts))
    assert len(set(want.values())) == 4 and any(jaccard(sets[0], sets[b]) < 0.8 for b in range(1, 10))
    df = spark.createDataFrame([*texts.items(), *[(d, t) for d, t in texts.items() if d % 3 == 0]], "doc_id long, text string")
    members = df.distinct().selectExpr("doc_id", "xxhash64(text) AS th", "array(1L, doc_id DIV 10) AS tables", "doc_id AS node")
    for list_bytes in (simhash.LIST_BYTES, 1):  # held in one task, and in rounds of hubs
        found = {x["node"]: x["component"] for x in simhash.similar_classes(df, members, 5, 0.8, list_bytes).collect()}
        assert {d: found.get(d, d) for d in texts} == want
    assert simhash.similar_classes(df, members.limit(0), 5, 0.8).count() == 0
