from __future__ import annotations

import math
import random

import numpy as np

from lantern.llm import topk


def plain(rows, every, k):
    ok = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in {i for i, _ in ok if i % every == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), i) for qi, v in ok if qi == q for i, w in ok if i != q]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(set(scores))[:k], 1)}
    return out


def test_against_plain_code(spark):
    r = random.Random(9)
    vec = lambda: [r.choice([r.gauss(0, 1), round(r.gauss(0, 1), 1)]) for _ in range(8)]
    rows = [(k, vec()) for k in range(120)] + [(k, [0.5] * 8) for k in range(200, 215)] + [(None, vec()), (300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (310, [1.0, 2.0, 3.0]), (5, None)]
    rows += [rows[50], (320, []), (330, [1e9] * 8)]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")
    quantised = topk.quantised(df)
    for per_block, per_query in ((8192, 1024), (16, 3)):
        got = topk.top_k(quantised, quantised["vec_id"] % 10 == 0, 5, per_block, per_query)
        assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got.collect()} == plain(rows, 10, 5)
    assert topk.search(df.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(one).count() == 0


def vectors(seed=3):
    r = np.random.default_rng(seed)
    x = np.rint(r.normal(0, 50, (3000, 6)) * (1 + 20 * (r.random((3000, 1)) < 0.01)))
    return x, np.rint(r.normal(0, 50, (40, 6)))


def test_bounds_hold_and_prune():
    x, q = vectors()
    lists, true = topk.SortedLists(x), x @ q.T
    reading = topk.Reading(lists, q, np.ones((3000, 40), bool))
    for read in (1, 30, 700, 3000):
        reading.on(read)
        if read < 3000:
            lower, upper = reading.bounds()
            assert (lower <= true).all() and (true <= upper).all()
    assert (reading.known == true).all()
    reading = topk.Reading(lists, q, np.ones((3000, 40), bool))
    reading.on(750)
    reading.prune(5)
    assert reading.alive.mean() < 0.2  # most outsiders are dropped unread to the end
    got = {}
    for i, c, s, depth in topk.best_of_block(np.arange(3000), lists, np.arange(5000, 5040), q):
        got.setdefault(i - 5000, []).append((s, c))
        assert depth < 1
    for j in range(40):
        assert got[j] == [(int(true[c, j]), int(c)) for c in np.lexsort((np.arange(3000), -true[:, j]))[:5]]


def test_every_entry_is_read_once_and_in_order(monkeypatch):
    """Scores come from the lists alone: what is read of each goes up without a gap, and after the
    stop only for the candidates left."""
    x, q = vectors()
    read = []
    on = topk.Reading.on

    def noted(self, to, some=None):
        read.append((self.read, to, len(self.lists.who[0]) if some is None else int(some.sum())))
        on(self, to, some)

    monkeypatch.setattr(topk.Reading, "on", noted)
    lists = topk.SortedLists(x)
    assert not hasattr(lists, "x")  # no vector is held beside the lists
    list(topk.best_of_block(np.arange(3000), lists, np.arange(5000, 5010), q[:10]))
    assert read[0][0] == 0 and read[-1][1] == 3000 and all(a[1] == b[0] for a, b in zip(read, read[1:], strict=False))
    assert read[-1][2] < 600 and all(n == 3000 for *_, n in read[:-1])


def test_depths(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = topk.depths(rows).collect()
    assert len(found) == rows.where("vec_id % 50 = 0").count() and all(0 < r["depth"] <= 1 for r in found)
