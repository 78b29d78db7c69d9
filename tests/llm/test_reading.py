from __future__ import annotations

import numpy as np

from lantern.llm import topk


def test_reading_leaves_few_candidates():
    r = np.random.default_rng(3)
    x = np.floor(256 * r.normal(size=(2000, 64)) / 8).astype(np.float64)
    ids, q = np.arange(2000), x[:40]
    left = topk.still_open(topk.SortedLists(x), ids[:, None] != ids[None, :40], q, 5)
    assert left.mean() < 0.02  # almost all are dropped by their bounds
    scores = x @ q.T
    scores[np.arange(40), np.arange(40)] = -np.inf
    got = sorted(topk.best_of_block(ids, x.astype(np.int64), ids[:40], q.astype(np.int64)))
    want = [(j, c, int(scores[c, j])) for j in range(40) for c in np.lexsort((ids, -scores[:, j]))[:5].tolist()]
    assert got == sorted(want) and all(left[c, j] for j, c, _ in want)


def test_equal_candidates_stay_open():
    x = np.ones((50, 4))
    assert topk.still_open(topk.SortedLists(x), np.ones((50, 3), bool), x[:3], 5).all()
