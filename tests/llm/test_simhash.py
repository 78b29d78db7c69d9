from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from lantern.llm import simhash


def plain_fingerprint(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_long_texts_go_in_slabs(monkeypatch):
    texts = ["one", "one two", " a b  c d e f g h i j k l m n o p q\n", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxx y z", "", "  ", "a b c " * 50]
    whole = [simhash.fingerprint(t) for t in texts]
    assert whole == [plain_fingerprint(t, 3) for t in texts]
    for slab in (1, 2, 5, 16):
        monkeypatch.setattr(simhash, "SLAB", slab)
        assert [simhash.fingerprint(t) for t in texts] == whole


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]


def test_any_three_positions_lie_in_one_block():
    from itertools import combinations

    assert all(sum(set(t) <= set(b) for b in simhash.BLOCKS) == 1 for t in combinations(range(8), 3))
    assert all(tuple(sorted(set(range(8)) - set(b))) in {tuple(sorted(x)) for x in simhash.BLOCKS} for b in simhash.BLOCKS)


def test_fingerprints(edge_docs):
    for r in simhash.near_duplicates(edge_docs).join(edge_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert int(r["fingerprint"], 16) == plain_fingerprint(r["text"], 3)


@pytest.mark.parametrize("list_max", [4096, 6])
def test_lists_keep_every_link(monkeypatch, list_max):
    monkeypatch.setattr(simhash, "LIST_MAX", list_max)
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(40)})

    def scan(rows, bounded):
        rows = rows.sort_values(["list", "key"])
        out = list(simhash._scan_lists(bounded)(iter([rows.iloc[k : k + 101] for k in range(0, len(rows), 101)])))
        return pd.concat(out) if out else pd.DataFrame(columns=["list", "key", "u", "v"])

    posted = pd.concat(simhash._post(iter([pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)})])))
    first = scan(posted, False)
    edges = [first[first.list == -1]]
    if len(more := first[first.list >= 0]):
        finer = pd.concat(simhash._post_finer(iter([pd.DataFrame({"list": more.list, "fp": more.u})])))
        edges.append(scan(finer, True))
    pairs = [(int(u) % 2**64, int(v) % 2**64) for e in edges for u, v in zip(e.u, e.v, strict=True)]
    assert set(map(frozenset, pairs)) <= set(map(frozenset, near(fps)))
    assert classes(pairs, fps) == classes(near(fps), fps)


def test_components(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(7, 7), (1, 0)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {x["node"]: x["component"] for x in simhash.components(df).collect()}
    want = classes(edges, {n for e in edges if e[0] != e[1] for n in e})
    assert got == want
    assert simhash.components(df.limit(0)).count() == 0


def test_whole_table_against_all_pairs(small):
    docs = {r["doc_id"]: r["text"] for r in small.collect()}
    fps = {k: plain_fingerprint(t, 3) for k, t in docs.items()}
    keys = sorted(fps)
    want = classes([(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3], keys)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(small).collect()}
    assert got == want


def test_edges(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count() and {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {20}
    assert {r["component_id"] for r in rows if r["doc_id"] == 23} == {1} and simhash.near_duplicates(no_docs).count() == 0
    left = simhash.keep_one(edge_docs, 3)
    kept = left.collect()
    assert left.columns == edge_docs.columns and len(kept) == len({r["component_id"] for r in rows})
    assert simhash.keep_one(no_docs).count() == 0
