"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most
three bits share at least five of them: that is the guaranteed minimum of matches. The
index posts each distinct fingerprint under keys of four positional bytes. The fourteen
blocks of the Steiner system S(3,4,8) are those keys: any three positions lie in just
one block, so whatever three bytes differ, one key avoids them all and both fingerprints
stand in its list. Within a list the shared positional bytes of each pair are tallied,
pairs under five matches are dropped and the rest verified bit by bit. A list gives a
spanning forest of its links, never all pairs.

A list with more than LIST_MAX members is posted again by five of the eight half bytes
it does not share (at most three of them differ). Such a list leaves 12 bits open, so it
has at most 4096 distinct members: every list is bounded however the corpus grows.

Equal fingerprints are one member from the start, so copies cost nothing. Components of
the forests are found by alternating large-star and small-star rounds on checkpointed
edges; nothing about all documents reaches the driver.

Where a similarity is asked for (keep_one, the pipeline's stage), texts whose shingle sets
agree to it are linked besides, however many bits lie between their fingerprints: at a
Jaccard similarity of 0.8 that is about ten. TABLES more fingerprints a text, each of a
min-wise sample of SAMPLED shingles, agree in at least one table with a probability of
0.998 at 0.8 and more above it (1 - (1 - J ** SAMPLED) ** TABLES); they only gather
candidates. Within a list of texts that share one, two are linked if the shared part of
their whole sets of shingle hashes (64 bits) reaches the similarity. A text is compared with
the texts of a component until it is linked to it, so a group of copies costs about one
comparison each. A task holds up to LIST_BYTES of a list's sets. A longer list is worked off
in rounds instead: a few of its texts are hubs, the others are compared with them, and hubs
leave the list, which ends when all that are left of it are in one component. Each round
takes HUBS_GROW times as many hubs; a task holds the set of one hub, whose comparisons go in
parts of HUB_PAIRS.

Cases: a null text has no words, like an empty one: fingerprint zero, linked like any
other. Repeated rows and rows of one doc_id each come back. component_id is null only if
no row of the component has a doc_id. An empty table gives an empty result. Extra
columns are ignored. A very long text is read a slab of words at a time; its shingle set, where
one is needed, is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import checkpoint, own_names, released, sealed, shuffle_width, unsealed

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_BYTES = 5
LIST_MAX = 4096
EDGES_PER_PART = 500_000
#: Sample fingerprints of a text, and the shingles each is taken of.
TABLES, SAMPLED = 12, 4
#: About how many hubs a list has at first, how many times more in each round, and how many texts one
#: task compares with a hub.
HUBS, HUBS_GROW, HUB_PAIRS = 1, 8, 2000
#: Bytes of the shingle sets of one list that a task holds.
LIST_BYTES = 64 << 20
#: Bytes of shingle sets that a worker puts into one batch.
SETS_BYTES = 4 << 20
#: Bytes of a text whose words are held at once.
SLAB = 1 << 20
_GAP = re.compile(rb"[ \t\n\x0b\f\r]").search

#: The fourteen blocks of S(3,4,8), as positions 0 to 7.
BLOCKS = (
    (0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 1, 6, 7), (2, 3, 4, 5), (0, 2, 4, 6),
    (1, 3, 5, 7), (0, 2, 5, 7), (1, 3, 4, 6), (0, 3, 4, 7), (1, 2, 5, 6), (0, 3, 5, 6), (1, 2, 4, 7),
)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, a slab of its words at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    digest = xxhash.xxh64_intdigest
    carried: list[bytes] = []
    few = True
    at = 0
    while at < len(data):
        end = at + SLAB
        if end < len(data):
            gap = _GAP(data, end)
            end = gap.start() if gap else len(data)
        words = carried + data[at:end].split()
        at = end
        if len(words) >= shingle:
            few = False
            yield np.array([digest(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(shingle)), strict=False)], dtype=">u8")
        carried = words[-(shingle - 1) :] if shingle > 1 else []
        if few:
            carried = words
    if few and carried:
        yield np.array([digest(b" ".join(carried), SEED)], dtype=">u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        total += len(hashes)
        for lo in range(0, len(hashes), 65536):
            ones += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _odd(n: int) -> np.ndarray:
    """N odd multipliers."""
    return np.array([xxhash.xxh64_intdigest(b"sample %d" % k, SEED) | 1 for k in range(n)], dtype=np.uint64)


_MULTIPLIERS = _odd(TABLES * SAMPLED)


def _least(hashes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least value of the hashes, and of what was least so far, under each multiplier."""
    mixed = hashes.astype(np.uint64)
    mixed ^= mixed >> np.uint64(29)
    for lo in range(0, len(mixed), 2048):
        least = np.minimum(least, (mixed[None, lo : lo + 2048] * _MULTIPLIERS[:, None]).min(axis=1))
    return least


def sampled(text: str | None, shingle: int = SHINGLE) -> tuple[int, list[int]]:
    """A text's fingerprint and those of its samples (signed), a table each; none without a word."""
    ones, total = np.zeros(64, np.int64), 0
    least = np.full(TABLES * SAMPLED, 2**64 - 1, np.uint64)
    for hashes in shingle_hashes(text, shingle):
        total += len(hashes)
        for lo in range(0, len(hashes), 65536):
            ones += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        least = _least(hashes, least)
    fp = int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)
    tables = least.reshape(TABLES, SAMPLED) if total else ()
    return fp, [xxhash.xxh64_intdigest(x.tobytes(), k) - 2**63 for k, x in enumerate(tables)]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    parts = [np.unique(h.astype(np.uint64)) for h in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.uint64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two ascending sets is at least so much."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return shared >= similarity * (len(a) + len(b) - shared)


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id (sealed) and fp, the fingerprint's 64 bits as a signed long."""

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return df.select(sealed("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def tally(x: np.ndarray) -> np.ndarray:
    """How many of its eight bytes are zero: of the XOR of a pair, the bytes it shares."""
    return (x[..., None].view(np.uint8) == 0).sum(axis=-1)


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (uint64)."""
    n = len(members)
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for i in range(n - 1):
        x = members[i + 1 :] ^ members[i]
        near = np.nonzero(popcount(x) <= MAX_BITS)[0] if n > 64 else np.arange(n - 1 - i)
        near = near[tally(x[near]) >= MIN_BYTES] if len(near) else near
        for j in near[popcount(x[near]) <= MAX_BITS].tolist():
            a, b = find(i), find(i + 1 + j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, i + 1 + j))
    return out


def _key(fps: np.ndarray, positions: tuple[int, ...], width: int) -> np.ndarray:
    """The parts of width bits at these positions, side by side."""
    out = np.zeros(len(fps), np.uint64)
    part = np.uint64((1 << width) - 1)
    for p in positions:
        out = (out << np.uint64(width)) | ((fps >> np.uint64(p * width)) & part)
    return out


@released
def _post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = b["fp"].to_numpy().view(np.uint64)
        yield pd.DataFrame({
            "list": np.repeat(np.arange(len(BLOCKS)), len(fps)),
            "key": np.concatenate([_key(fps, block, 8) for block in BLOCKS]).view(np.int64),
            "fp": np.tile(fps, len(BLOCKS)).view(np.int64),
        })


@released
def _post_finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A member of an oversized list under five of the eight half bytes that its key leaves open."""
    chosen = list(combinations(range(8), 5))
    for b in batches:
        for block, rows in b.groupby("list"):
            fps = rows["fp"].to_numpy().view(np.uint64)
            halves = [h for p in range(8) if p not in BLOCKS[block] for h in (2 * p, 2 * p + 1)]
            same = _key(fps, BLOCKS[block], 8)
            for k, five in enumerate(chosen):
                key = (same << np.uint64(20)) | _key(fps, tuple(halves[i] for i in five), 4)
                yield pd.DataFrame({"list": block * len(chosen) + k, "key": key.view(np.int64), "fp": rows["fp"]})


def _scan_lists(bounded: bool):
    """Rows sorted by list and key -> forest edges (u > v); a list over LIST_MAX comes back as
    rows for finer lists (v null) unless lists are bounded."""

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []
        head: tuple[int, int] | None = None
        size = 0

        def close() -> list[tuple[int, int, int, int | None]]:
            nonlocal kept, size
            members = np.unique(np.concatenate(kept)).view(np.uint64) if size > 1 else np.empty(0, np.uint64)
            kept, size = [], 0
            signed = members.view(np.int64).tolist()
            return [(-1, 0, max(signed[i], signed[j]), min(signed[i], signed[j])) for i, j in forest(members)]

        def frame(rows: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["list", "key", "u", "v"])
            return out.astype({"list": "int32", "key": "int64", "u": "int64", "v": "int64"})

        for b in batches:
            lists, keys, fps = b["list"].to_numpy(), b["key"].to_numpy(), b["fp"].to_numpy()
            cuts = np.nonzero((lists[1:] != lists[:-1]) | (keys[1:] != keys[:-1]))[0] + 1
            rows: list = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True):
                if lo == hi:
                    continue
                this = (int(lists[lo]), int(keys[lo]))
                if this != head:
                    if size > 1 and size <= LIST_MAX or bounded:
                        rows += close()
                    kept, size, head = [], 0, this
                part = fps[lo:hi]
                if bounded or size + len(part) <= LIST_MAX:
                    kept.append(part)
                else:  # too long: what has been held goes out as well
                    for x in [*kept, part]:
                        rows += [(this[0], this[1], f, f) for f in x.tolist()]
                    kept = []
                size += len(part)
            if rows:
                yield frame(rows)
        if size > 1 and (size <= LIST_MAX or bounded) and (rows := close()):
            yield frame(rows)

    return run


def links(distinct: DataFrame, width: int | None = None) -> DataFrame:
    """Forest edges (u, v), u > v, between distinct fingerprints (column fp)."""
    width = width or shuffle_width(distinct.sparkSession)
    schema, out = "list int, key long, fp long", "list int, key long, u long, v long"
    posted = distinct.select("fp").mapInPandas(_post, schema)
    first = checkpoint(posted.repartition(width, "list", "key").sortWithinPartitions("list", "key").mapInPandas(_scan_lists(False), out))
    edges = first.where("list = -1").select("u", "v")
    finer = (
        first.where("list >= 0").select("list", F.col("u").alias("fp")).mapInPandas(_post_finer, schema)
        .repartition(width, "list", "key").sortWithinPartitions("list", "key").mapInPandas(_scan_lists(True), out)
    )
    return edges.unionByName(finer.select("u", "v")).distinct()


def _scan_lists_of_sets(similarity: float, list_bytes: int):
    """Rows (key, node, th, hashes) sorted by key and th -> edges (u > v) between nodes that hold texts
    of this similarity, of a list a spanning forest; or the key of a list that is too long."""

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = last = None
        size = 0
        where: dict[int, int] = {}  # the component of each node
        held: dict[int, list[tuple[int, np.ndarray]]] = {}  # the nodes and sets of each component
        for b in batches:
            out: list[tuple] = []
            for key, node, th, data in zip(b["key"].tolist(), b["node"].tolist(), b["th"].tolist(), b["hashes"], strict=True):
                if key != head:
                    head, last, size, where, held = key, None, 0, {}, {}
                if th == last or size < 0:  # a repeated row, or a list that has been given up
                    continue
                last = th
                size += len(data)
                if size > list_bytes and held:
                    out.append((None, None, key))
                    size, where, held = -1, {}, {}
                    continue
                own = np.frombuffer(data, np.uint64)
                mine = where.setdefault(node, node)
                held.setdefault(mine, [])
                for other in [c for c in held if c != mine]:
                    for x, hashes in held[other]:
                        if alike(own, hashes, similarity):
                            out.append((max(node, x), min(node, x), None))
                            for moved in {n for n, _ in held[other]}:
                                where[moved] = mine
                            held[mine] += held.pop(other)
                            break
                held[mine].append((node, own))
            if out:
                yield pd.DataFrame(out, columns=["u", "v", "key"]).astype("Int64")

    return run


def _within_lists(df: DataFrame, posted: DataFrame, shingle: int, similarity: float, list_bytes: int) -> DataFrame:
    """u, v of the links within the lists of posted (doc_id, th, node, key); key alone of a list that is too long."""
    wanted = posted.groupBy("doc_id", "th", "node").agg(F.collect_set("key").alias("keys"))
    text = F.col("text").cast("string")
    texts = df.select(sealed("doc_id").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "node", "th", "hashes"]
        for b in batches:
            rows, size = [], 0
            for node, th, keys, text in zip(b["node"].tolist(), b["th"].tolist(), b["keys"], b["text"], strict=True):
                data = shingle_set(text, shingle).tobytes()
                for key in keys.tolist():
                    rows.append((key, node, th, data))
                    size += len(data)
                    if size > SETS_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    sets = texts.join(wanted, ["doc_id", "th"]).select("node", "th", "keys", "text").mapInPandas(run, "key long, node long, th long, hashes binary")
    dealt = sets.repartition(shuffle_width(df.sparkSession), "key").sortWithinPartitions("key", "th")
    return dealt.mapInPandas(_scan_lists_of_sets(similarity, list_bytes), "u long, v long, key long").distinct()


def _scan_sets(similarity: float):
    """Rows (hub, part, kind, node, hashes) sorted so, the hub itself (kind 0) before the texts it is
    compared with -> edges (u > v) between nodes that hold texts of this similarity."""

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple[int, int, int, np.ndarray] | None = None
        for b in batches:
            out = []
            for hub, part, kind, node, data in zip(b["hub"].tolist(), b["part"].tolist(), b["kind"].tolist(), b["node"].tolist(), b["hashes"], strict=True):
                if kind == 0:
                    at = hub, part, node, np.frombuffer(data, np.uint64)
                elif at is not None and at[:2] == (hub, part) and alike(np.frombuffer(data, np.uint64), at[3], similarity):
                    out.append((max(node, at[2]), min(node, at[2])))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"]).drop_duplicates()

    return run


def _compared(df: DataFrame, pairs: DataFrame, hubs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (u, v) of pairs (doc_id, th, node, hub) whose texts are alike; hubs: doc_id, th, node of each hub."""
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    members = pairs.join(counts, "hub").select("doc_id", "th", "hub", F.pmod(F.xxhash64("th"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "node")
    own = hubs.join(counts, hubs["th"] == counts["hub"]).select(
        "doc_id", "th", "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "node"
    )
    asked = members.unionByName(own).groupBy("doc_id", "th").agg(F.collect_list(F.struct("hub", "part", "kind", "node")).alias("asked"))
    text = F.col("text").cast("string")
    texts = df.select(sealed("doc_id").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["hub", "part", "kind", "node", "hashes"]
        last = None
        for b in batches:
            rows, size = [], 0
            for *document, asked, text in zip(b["doc_id"].tolist(), b["th"].tolist(), b["asked"], b["text"], strict=True):
                if document == last:  # a repeated row
                    continue
                last = document
                data = shingle_set(text, shingle).tobytes()
                for x in asked:
                    rows.append((x["hub"], x["part"], x["kind"], x["node"], data))
                    size += len(data)
                    if size > SETS_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    sets = texts.join(asked, ["doc_id", "th"]).select("doc_id", "th", "asked", "text").mapInPandas(run, "hub long, part int, kind int, node long, hashes binary")
    order = ("hub", "part", "kind")
    return sets.repartition(shuffle_width(df.sparkSession), "hub", "part").sortWithinPartitions(*order).mapInPandas(_scan_sets(similarity), "u long, v long").distinct()


def similar_classes(df: DataFrame, members: DataFrame, shingle: int, similarity: float, list_bytes: int = LIST_BYTES) -> DataFrame:
    """(node, component) of the nodes of members (doc_id, th, tables, node: a row of df each) that texts of
    this similarity link."""
    posted = members.select("doc_id", "th", "node", F.explode("tables").alias("key"))
    # Most lists are of one node; the others alone are kept.
    several = posted.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    left = posted.join(several, "key")
    within = checkpoint(_within_lists(df, left, shingle, similarity, list_bytes))
    edges = within.where("key is null").select("u", "v")
    found = components(edges)
    long = within.where("key is not null").select("key").distinct()
    if long.isEmpty():
        return found
    left = left.join(long, "key")
    hubs, turn = HUBS, 0
    while True:
        now = left.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        state = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("th").alias("low"), F.count("*").alias("n")).where("a < b")
        chance = F.pmod(F.xxhash64("th", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        now = now.join(state, "key").withColumn("is_hub", (F.col("th") == F.col("low")) | (chance < (hubs - 1) / F.col("n")))
        now = checkpoint(now.select("key", "doc_id", "th", "node", "component", "is_hub"))
        if now.isEmpty():
            return found
        of_list = now.where("is_hub").select("key", F.col("th").alias("hub"), F.col("component").alias("hub_component"))
        others = (F.col("component") != F.col("hub_component")) & (~F.col("is_hub") | (F.col("th") > F.col("hub")))
        pairs = now.join(of_list, "key").where(others).select("doc_id", "th", "node", "hub").distinct()
        chosen = now.where("is_hub").select("doc_id", "th", "node").distinct()
        new = _compared(df, pairs, chosen, shingle, similarity)
        edges = checkpoint(edges.unionByName(new))
        found = components(edges)
        left = now.where("not is_hub").select("key", "doc_id", "th", "node")
        hubs, turn = hubs * HUBS_GROW, turn + 1


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge are left out.

    Large-star hands a node's greater neighbours to its smallest neighbour; small-star does so
    with the smaller ones. Both are one grouped minimum and one join on the node, so a node
    with very many neighbours is combined before the shuffle and split in the join."""
    pairs = checkpoint(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    # A round leaves no more edges than it took, so few files hold the edges of the next.
    parts = max(1, -(-pairs.count() // EDGES_PER_PART))
    seen = None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = checkpoint(stars.coalesce(parts))
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now


def near_duplicates(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    docs = checkpoint(fingerprints(df, shingle))
    lowest = docs.groupBy("fp").agg(F.min(unsealed("doc_id")).alias("doc"))
    linked = components(links(lowest))
    joined = lowest.join(linked, lowest["fp"] == linked["node"], "left").select(
        "fp", "doc", F.coalesce("component", "fp").alias("component")
    )
    first = joined.groupBy("component").agg(F.min("doc").alias("component_id"))
    classes = joined.join(first, "component").select("fp", "component_id")
    return docs.join(classes, "fp").select(
        unsealed("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """df's rows without the near copies: of each component one row stays, the first by doc_id
    (null first), then by a hash of the text; of equal rows any one. With a similarity, texts
    whose shingle sets have it are near copies too."""
    text = F.col("text").cast("string")
    key, th = own_names(df, "_doc", "_th")
    docs = df.select(sealed("doc_id").alias("doc_id"), F.xxhash64(text).alias("th"), "text")

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if similarity is None:
                fp = np.array([fingerprint(x, shingle) for x in b["text"]], dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "fp": fp})
            else:
                done = [sampled(x, shingle) for x in b["text"]]
                yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "fp": [fp for fp, _ in done], "tables": [t for _, t in done]})

    made = checkpoint(docs.mapInPandas(run, "doc_id long, th long, fp long" + ", tables array<long>" * (similarity is not None)))
    lowest = made.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("row"))
    linked = components(links(lowest))
    joined = lowest.join(linked, lowest["fp"] == linked["node"], "left").select("fp", "row", F.coalesce("component", "fp").alias("component"))
    if similarity is not None:
        joined = checkpoint(joined)
        texts = made.groupBy("th").agg(F.min_by(F.struct("doc_id", "fp", "tables"), "doc_id").alias("m")).select("th", "m.*")
        members = texts.join(joined.select("fp", F.col("component").alias("node")), "fp")
        wider = similar_classes(df, members, shingle, similarity)
        wider = wider.withColumnRenamed("component", "wide")
        joined = joined.join(wider, joined["component"] == wider["node"], "left").select("row", F.coalesce("wide", "component").alias("component"))
    stays = joined.groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias(key), F.col("row.th").alias(th))
    keyed = df.withColumn(key, sealed("doc_id")).withColumn(th, F.xxhash64(text))
    left = keyed.join(stays, [key, th], "left_semi")
    # Of rows that agree in id and text one is left.
    return left.dropDuplicates([key, th]).select(*(F.col(f"`{c}`") for c in df.columns))
