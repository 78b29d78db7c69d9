"""Exact top-k by inner product with aggregation of sorted lists and no random access.

Every block of candidates keeps one list per dimension, sorted by value. For a query the
lists are read sequentially, each from the end that its weight favours, to equal depth
in rounds (DEPTHS). An entry that is read adds to what is known of its candidate's score;
this is the state, and nothing is read twice. The unread rest of a dimension lies between
the value last read and the far end of the list, which gives each candidate a lower and an
upper bound. After each round candidates whose upper bound is under the k-th best lower
bound are dropped. Reading for a block of queries stops when no more than FEW times k
candidates a query are left; what is then missing of their scores comes from the remaining
parts of the lists, read on in order for the candidates left alone.

On 64 dimensions without structure the bounds prune late: see the README for how deep the
lists are read. Nothing else answers in their place.

Layout: candidates are dealt into blocks of bounded size by a hash and are shuffled once;
blocks of queries travel to each of them and are read against its lists one by one. A block
returns k rows per query; the final ranking is a window over those.

Scores are exact integers: double-precision sums where dims * |q| * |x| < 2**53, else
64-bit integers (results beyond 64 bits are not defined).

Cases: vectors that are null, or hold a null or a non-finite component, take no part; nor
does a null vec_id. Repeated rows count once; rows of one vec_id with different vectors are
different candidates, none of its own id, and as queries are ranked together. Ties of score go
to the smaller vec_id. Vectors of different lengths are compared on the components that both
have. A query without candidates has no rows. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
#: Queries that are read together; their known parts are one matrix.
TOGETHER = 64
#: Parts of each list read after each round, to the end unless the stop rule holds before.
DEPTHS = (0.25, 0.5, 0.7, 0.8, 0.88, 0.94, 0.97, 0.99, 1.0)
#: Candidates left a query, in multiples of k, at which reading stops.
FEW = 8


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x).where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _blocks(rows: DataFrame, number: int, name: str) -> DataFrame:
    """One row per block: the distinct ids and vectors of the rows that a hash deals to it. Equal rows
    come to one block and are combined before the shuffle."""
    return (
        rows.groupBy(F.pmod(F.xxhash64("vec_id", "v"), F.lit(number)).cast("int").alias(name))
        .agg(F.sort_array(F.collect_set(F.struct("vec_id", "v"))).alias("rows"))
    )


def _matrix(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a block; shorter vectors are padded with zeros."""
    ids, vectors = block.values.flatten()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    x[np.arange(x.shape[1]) < lengths[:, None]] = flat
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), x


class SortedLists:
    """The lists of one block of candidates: who stands where and with what value, by dimension."""

    def __init__(self, x: np.ndarray):
        self.size, self.dims = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(x, order, axis=0).T)  # a row per dimension
        self.who = np.ascontiguousarray(order.T)
        self.rank = np.empty((self.size, self.dims), np.int32)
        np.put_along_axis(self.rank, order, np.arange(self.size, dtype=np.int32)[:, None], axis=0)
        self.largest = int(np.abs(x).max(initial=0))


class Reading:
    """A few queries on their way through the lists of one block."""

    def __init__(self, lists: SortedLists, q: np.ndarray, alive: np.ndarray):
        self.lists, self.alive = lists, alive
        # From the top for weights over zero, from the bottom for those under it.
        self.plus, self.minus = np.maximum(q, 0).T, np.minimum(q, 0).T
        self.known = np.zeros((lists.size, len(q)), q.dtype)
        self.read = 0

    def on(self, to: int, some: np.ndarray | None = None) -> None:
        """Reads every list on to this depth; some: of these candidates alone."""
        lists, n = self.lists, self.lists.size
        for d in range(lists.dims):
            for lo, hi, weight in ((n - to, n - self.read, self.plus[d]), (self.read, to, self.minus[d])):
                if not weight.any():
                    continue
                who, values = lists.who[d, lo:hi], lists.values[d, lo:hi]
                if some is not None:
                    kept = some[who]
                    who, values = who[kept], values[kept]
                self.known[who] += values[:, None] * weight
        self.read = to

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (candidates x queries): what is known, and the rest of each list at its
        far end or at the value last read."""
        lists, n, read = self.lists, self.lists.size, self.read
        top, bottom = lists.values[:, n - read, None], lists.values[:, read - 1, None]
        low, high = lists.values[:, 0, None], lists.values[:, -1, None]
        kind = self.known.dtype
        open_top, open_bottom = (lists.rank < n - read).astype(kind), (lists.rank >= read).astype(kind)
        upper = self.known + open_top @ (self.plus * top) + open_bottom @ (self.minus * bottom)
        lower = self.known + open_top @ (self.plus * low) + open_bottom @ (self.minus * high)
        return lower, upper

    def prune(self, k: int) -> None:
        """Drops the candidates that cannot be among the k best any more."""
        lower, upper = self.bounds()
        lower[~self.alive] = -(2**62)
        n = len(lower)
        if n > k:
            bar = np.partition(lower, n - k, axis=0)[n - k]
            self.alive &= upper >= bar

    def run(self, k: int) -> float:
        """Reads until few candidates are left, then the rest for those; returns the depth of the stop."""
        n = self.lists.size
        for depth in DEPTHS:
            to = int(n * depth)
            if to > self.read:
                self.on(to)
            if self.read == n:
                return 1.0
            if self.read > k:
                self.prune(k)
                if self.alive.sum() <= FEW * k * self.alive.shape[1]:
                    break
        stopped = self.read / n
        self.on(n, self.alive.any(axis=1))
        return stopped


def best_of_block(ids: np.ndarray, lists: SortedLists, qids: np.ndarray, q: np.ndarray, k: int = K) -> Iterator[tuple[int, int, int, float]]:
    """(query_id, vec_id, score, depth read) of the k best candidates of each query within a block."""
    for lo in range(0, len(q), TOGETHER):
        own = qids[lo : lo + TOGETHER]
        reading = Reading(lists, q[lo : lo + TOGETHER], ids[:, None] != own[None, :])
        depth = reading.run(k)
        for j in range(len(own)):
            left = np.nonzero(reading.alive[:, j])[0]
            s = reading.known[left, j]
            if len(left) > k:
                bar = np.partition(s, len(s) - k)[len(s) - k]
                left, s = left[s >= bar], s[s >= bar]
            for c in np.lexsort((ids[left], -s))[:k].tolist():
                yield int(own[j]), int(ids[left[c]]), int(s[c]), depth


def _answer(k: int):
    """Rows (c, b, rows) sorted by c and b: a block of candidates (b = -1), then blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            for i in range(b.num_rows):
                ids, x = _matrix(b.column(2)[i])
                if b.column(1)[i].as_py() < 0:
                    block = (b.column(0)[i].as_py(), ids, x, {})
                    continue
                if block is None or block[0] != b.column(0)[i].as_py():
                    continue  # a hash that no candidate has
                width = min(block[2].shape[1], x.shape[1])
                x = x[:, :width]
                exact = width * float(np.abs(block[2]).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53
                kind = np.float64 if exact else np.int64
                if (width, kind) not in block[3]:
                    block[3][width, kind] = SortedLists(block[2][:, :width].astype(kind))
                rows = list(best_of_block(block[1], block[3][width, kind], ids, x.astype(kind), k))
                columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score", "depth"])

    return run


def found_in_blocks(rows: DataFrame, is_query: Column, k: int, per_block: int, queries_per_block: int) -> DataFrame:
    """query_id, vec_id, score, depth: the k best of each block of candidates for each query."""
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    nc, nq = max(1, -(-n // per_block)), max(1, -(-m // queries_per_block))
    cands = _blocks(rows, nc, "c").select("c", F.lit(-1).alias("b"), "rows")
    queries = _blocks(rows.where(is_query), nq, "b").select(F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("c"), "b", "rows")
    width = min(nc, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    both = cands.unionByName(queries).repartition(width, "c").sortWithinPartitions("c", "b")
    return both.mapInArrow(_answer(k), "query_id long, vec_id long, score long, depth double")


def top_k(
    rows: DataFrame, is_query: Column, k: int = K, per_block: int = CANDIDATES_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score over quantised rows (vec_id, v)."""
    found = found_in_blocks(rows, is_query, k, per_block, queries_per_block).select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def depths(df: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, depth: the greatest part of any block's lists that was read before reading stopped."""
    rows = quantised(df)
    found = found_in_blocks(rows, F.col("vec_id") % every == 0, k, CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK)
    return found.groupBy("query_id").agg(F.max("depth").alias("depth"))


def search(df: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The k best of all rows for each row whose vec_id is divisible by every."""
    return top_k(quantised(df), F.col("vec_id") % every == 0, k)
