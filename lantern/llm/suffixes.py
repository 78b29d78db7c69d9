"""Suffix-array deduplication by common-prefix intervals.

Every byte covered by a string of MIN bytes that also starts earlier (smaller doc_id, or
the same document further left) is removed. A whole corpus has no single suffix array; what
can repeat together is brought together first, without its text:

1. Each string of MIN bytes has one anchor, the smallest hash of its GRAM-byte strings.
   Equal strings have equal anchors. Neighbouring strings mostly share theirs, so a
   document becomes runs of strings, one row (anchor, hash of the run's bytes, place) each.
2. The rows meet by anchor. A run whose anchor has no other run (and that cannot repeat
   within itself) holds no repeat. All others become segments: equal runs are one segment
   with a list of places, whose bytes are looked up once. Segments that follow each other in
   all of their places, as in copies, are one longer segment.
3. Segments are concatenated, whole anchors and about BATCH bytes at a time, into an
   enhanced suffix array. A stack scan builds the tree of common-prefix intervals; an
   interval whose occurrences are preceded by different bytes, or a segment with several
   places, is a maximal repeat, a group with all its occurrences. Every occurrence of a
   group but the first is removed.

The suffix array holds only the suffixes that can begin a maximal repeat: those whose first
MIN bytes occur again, behind different bytes. They are sorted seven bytes at a time, and
by prefix tripling where they agree for long.

Before the shuffle, equal runs of one slab of text become a segment in the same way, and
only its first place travels on: a passage that a third of all documents shares reaches its
anchor as one row for each slab, a megabyte of text. A segment lists PLACES_MAX places; further
ones are listed by segments of their own, in the documents where those begin. An anchor with more than OPEN_MAX rows
or ANCHOR_BYTES bytes of runs is never held whole: the places of a run go on in several
segments, each by itself, and the runs are cut into their strings of MIN bytes, which are
segments with anchors of their own.

Cases: a null text is empty; a text under MIN bytes loses nothing. A very long text goes in
pieces of PIECE bytes that share no string and miss none. Rows that agree in doc_id and text
(by 128 bits of hash) are one document and each get its result; rows that share a doc_id but
not the text are ordered by that hash. A null doc_id comes before all others. An empty table
gives an empty result. Extra columns are ignored, or kept by without_repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import own_names, released, sealed, shuffle_width, text_or_empty, unsealed

MIN = 100
GRAM = 32
#: Bytes of text whose runs are found at once, and of a long document's pieces.
SLAB, PIECE = 1 << 20, 1 << 18
#: Bytes of segments in one suffix array, beside those of the last anchor.
BATCH = 900_000
#: Rows and bytes of one anchor that are held together.
OPEN_MAX, ANCHOR_BYTES = 16_384, 1 << 20
#: Further places of a run that one segment lists; the next ones are listed with the first of them.
PLACES_MAX = 128
#: Rounds of seven bytes before suffixes are told apart by prefix tripling.
ROUNDS = 64

PLAIN, SELF, SPAN = 0, 1, 2  # kinds of rows by anchor; SELF: may repeat within itself
#: Kinds of rows by document. LATER: a segment known to stand earlier too; SOLE: one whose anchor has no other.
REPEAT, SEGMENT, LATER, STRINGS, SOLE = 0, 1, 2, 3, 4
PLACE = np.dtype([("doc", "<i8"), ("t1", "<i8"), ("t2", "<i8"), ("s", "<i8")])
DOCUMENT = ["doc", "t1", "t2"]


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


_BYTE = _random_words(256, 7)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of data[i : i + gram] for each i; gram is a power of two. The last ones are short."""
    h = _BYTE[data]
    size, factor = 1, int(_STEP)
    while size < gram:
        nxt = h * np.uint64(factor)
        nxt[:-size] += h[size:]
        h, size, factor = nxt, 2 * size, factor * factor % 2**64
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """min(h[i : i + width]) for each i that has so many."""
    m, size = h, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - size : len(h) - size + 1])


def runs(texts: list[bytes], min_len: int = MIN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, count, anchor, within): runs of strings of min_len bytes with one anchor;
    within tells that the anchor occurs at several places, so the run may repeat itself."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < min_len:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    h = _gram_hashes(data, gram)
    v = _window_min(h, min_len - gram + 1)[: len(data) - min_len + 1]
    ends = np.cumsum(lengths)
    edge = np.zeros(len(data) + 1, np.int64)
    lo = np.maximum(ends - min_len + 1, ends - lengths)
    np.add.at(edge, lo, 1)
    np.add.at(edge, ends, -1)
    fits = (np.cumsum(edge)[: len(v)]) == 0
    new = np.r_[True, (v[1:] != v[:-1]) | ~fits[:-1]] & fits
    last = np.r_[(v[1:] != v[:-1]) | ~fits[1:], True] & fits
    b, e = np.nonzero(new)[0], np.nonzero(last)[0]
    leaves = np.r_[0, np.cumsum(h[: len(v)] == v)]
    within = leaves[e] > leaves[b]
    which = np.searchsorted(ends, b, side="right")
    return which, b - (ends - lengths)[which], e - b + 1, v[b], within


class Ranks:
    """Prefix tripling over whole segments: for suffixes that agree for long."""

    PACK = 7

    def __init__(self, data: np.ndarray, ends: np.ndarray, longest: int):
        """data: bytes + 1 with 0 behind each segment, where ends points."""
        n = len(data)
        self.data, self.rest = data, (np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)).astype(np.int32)
        padded = np.r_[data, np.zeros(self.PACK, data.dtype)]
        key = np.zeros(n, np.int64)
        for k in range(self.PACK):
            key = (key << 9) | padded[k : k + n]
        self.levels, self.sizes = [self._dense(key)], [self.PACK]
        # Ranks of three neighbours make the next rank while they fit in 63 bits, else of two.
        self.join = 3 if n < 1 << 20 else 2
        while self.sizes[-1] < longest and self.levels[-1].max() < n - 1:
            r, size = self.levels[-1], self.sizes[-1]
            key = r.astype(np.int64)
            for k in range(1, self.join):
                key *= n + 1
                key[: max(0, n - k * size)] += r[k * size :].astype(np.int64) + 1
            self.levels.append(self._dense(key))
            self.sizes.append(size * self.join)

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        out = np.empty(len(key), np.int32)
        out[order] = np.r_[0, np.cumsum(s[1:] != s[:-1])]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common prefix lengths of suffixes i and j."""
        last = len(self.data) - 1
        out = np.zeros(len(i), np.int64)
        for ranks, size in zip(reversed(self.levels), reversed(self.sizes), strict=True):
            for _ in range(self.join - 1):
                out += np.where(ranks[np.minimum(i + out, last)] == ranks[np.minimum(j + out, last)], size, 0)
        for _ in range(self.PACK - 1):
            out += self.data[np.minimum(i + out, last)] == self.data[np.minimum(j + out, last)]
        return np.minimum(out, np.minimum(self.rest[i], self.rest[j]))


class Enhanced:
    """Suffix array of segments with common prefix lengths that stop at segment ends, of the
    suffixes that can begin a maximal repeat of min_len bytes."""

    WORD = 7

    def __init__(self, segments: Sequence[bytes], min_len: int):
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        self.data = np.frombuffer(b"".join([*segments, bytes(8)]), np.uint8)
        ends = np.cumsum(lengths)
        self.starts = ends - lengths
        which = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
        n = int(lengths.sum())
        rest = ends[which] - np.arange(n)
        at, group = self._again(np.nonzero(rest >= min_len)[0], which, min_len)
        self.sa, self.lcp = self._sorted(at, group, rest, which, segments)
        self.segment = which[self.sa]
        self.before = self._before(self.sa, self.segment)

    def _before(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The byte before each place; -1 where a segment begins."""
        return np.where(at > self.starts[segment], self.data[at - 1].astype(np.int16), np.int16(-1))

    def _again(self, at: np.ndarray, which: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places at, those whose min_len bytes occur again behind different bytes, and a
        number for equal ones. All intervals of a group with one byte before it are extended by it."""
        if len(at) < 2:
            return at[:0], at[:0]
        size = 1 << (min_len.bit_length() - 1)
        h = _gram_hashes(self.data, size)
        key = h[at] * _STEP ^ h[at + (min_len - size)]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.r_[True, key[1:] != key[:-1]]
        heads = np.nonzero(first)[0]
        before = self._before(at, which[at])
        low, high = np.minimum.reduceat(before, heads), np.maximum.reduceat(before, heads)
        wanted = (np.diff(np.r_[heads, len(at)]) > 1) & ((low != high) | (low < 0))
        group = np.cumsum(first) - 1
        keep = wanted[group]
        return at[keep], group[keep]

    def _words(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Seven bytes from each place and how many of them are the segment's."""
        count = np.clip(left, 0, self.WORD)
        raw = self.data[np.minimum(at, len(self.data) - 8)[:, None] + np.arange(8)].view(">u8")[:, 0].astype(np.uint64)
        shift = (8 * (8 - count)).astype(np.uint64)
        raw = np.where(count > 0, (raw >> np.minimum(shift, np.uint64(56))) << np.minimum(shift, np.uint64(56)), np.uint64(0))
        return raw | count.astype(np.uint64)

    def _sorted(self, at: np.ndarray, group: np.ndarray, rest: np.ndarray, which: np.ndarray, segments: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places by group and then by their bytes, and the common prefix of each with the next."""
        m = len(at)
        sa, lcp = at.copy(), np.zeros(max(0, m - 1), np.int64)
        slots, group = np.arange(m), group.copy()  # places still to be told apart stand in these slots
        done = 0
        while len(slots) and done < ROUNDS * self.WORD:
            here = sa[slots]
            key = self._words(here + done, rest[here] - done)
            order = np.lexsort((key, group))
            sa[slots], key = here[order], key[order]  # a group keeps its slots
            same_group = group[1:] == group[:-1]
            equal = same_group & (key[1:] == key[:-1])
            full = (key & np.uint64(255)) == self.WORD
            apart = same_group & ~equal
            x = (key[1:] ^ key[:-1])[apart] >> np.uint64(8)
            shared = np.minimum((key[1:] & np.uint64(255))[apart], (key[:-1] & np.uint64(255))[apart]).astype(np.int64)
            bytes_equal = np.where(x == 0, self.WORD, (56 - np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)) // 8)
            lcp[slots[:-1][apart]] = done + np.minimum(shared, np.maximum(bytes_equal, 0))
            ended = equal & ~full[1:]
            lcp[slots[:-1][ended]] = done + (key[1:] & np.uint64(255))[ended].astype(np.int64)
            more = equal & full[1:]
            stays = np.r_[False, more] | np.r_[more, False]
            group = np.cumsum(np.r_[True, ~equal])[stays]
            slots = slots[stays]
            done += self.WORD
        if len(slots):
            self._by_rank(sa, lcp, slots, group, which, segments)
        return sa, lcp

    def _by_rank(self, sa: np.ndarray, lcp: np.ndarray, slots: np.ndarray, group: np.ndarray, which: np.ndarray, segments: Sequence[bytes]) -> None:
        """The rest, whose places agree for long within their groups."""
        chosen = np.unique(which[sa[slots]])
        parts = [segments[k] for k in chosen.tolist()]
        data = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int16) + 1
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        data[ends] = 0
        ranks = Ranks(data, ends, int(lengths.max()))
        here = sa[slots]
        own = np.searchsorted(chosen, which[here])
        place = here - self.starts[which[here]] + (ends - lengths)[own]
        order = np.lexsort((ranks.levels[-1][place], group))
        sa[slots] = here[order]
        place = place[order]
        same = np.nonzero(group[1:] == group[:-1])[0]
        lcp[slots[same]] = ranks.common(place[same], place[same + 1])

    def intervals(self, min_len: int, order: np.ndarray) -> Iterator[tuple[int, int, int, list[int], bool]]:
        """The common-prefix intervals of at least min_len, children before parents: (length,
        first and last index into sa, heads, diverse). Heads are the first occurrences, by order, of
        the interval's children and its own suffixes; diverse: different bytes stand before."""
        lcp, before, rank = self.lcp.tolist(), self.before.tolist(), order.tolist()
        stack: list[list] = []  # [length, left, heads, byte before: -1 different]

        def close(node: list, right: int) -> tuple[int, tuple]:
            first = min(node[2], key=rank.__getitem__)
            return first, (node[0], node[1], right, node[2], node[3] == -1)

        for i in range(len(rank)):
            here = lcp[i] if i < len(lcp) and lcp[i] >= min_len else 0
            head, left, byte = i, i, before[i]
            if not stack or here > stack[-1][0]:
                if here:
                    stack.append([here, left, [head], byte])
                continue
            top = stack[-1]
            top[2].append(head)
            top[3] = byte if top[3] == byte else -1
            while stack and here < stack[-1][0]:
                node = stack.pop()
                head, done = close(node, i)
                yield done
                left, byte = node[1], node[3]
                if stack and stack[-1][0] >= here:
                    up = stack[-1]
                    up[2].append(head)
                    up[3] = byte if up[3] == byte else -1
                elif here:
                    stack.append([here, left, [head], byte])
                    break


def maximal_repeats(texts: list[bytes], min_len: int = MIN) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences as (text, start)) of every maximal repeat of at least min_len bytes."""
    e = Enhanced(texts, min_len)
    out = []
    for length, lo, hi, _, diverse in e.intervals(min_len, np.arange(len(e.sa))):
        if diverse:
            at = e.sa[lo : hi + 1]
            out.append((length, sorted(zip(e.segment[lo : hi + 1].tolist(), (at - e.starts[e.segment[lo : hi + 1]]).tolist(), strict=True))))
    return out


def _numbers(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each place's document, in order, and the first place that has it."""
    order = np.lexsort((place["t2"], place["t1"], place["doc"]))
    p = place[order]
    new = np.r_[True, (p["doc"][1:] != p["doc"][:-1]) | (p["t1"][1:] != p["t1"][:-1]) | (p["t2"][1:] != p["t2"][:-1])]
    number = np.empty(len(place), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def later_spans(segments: list[bytes], place: np.ndarray, others: list[np.ndarray | None], later: np.ndarray, min_len: int = MIN) -> pd.DataFrame:
    """(doc, t1, t2, s, e): every occurrence but the first of each maximal repeat of the segments, joined
    where they touch. place: where each segment stands; others: further places of it, all behind
    that; later: whether it stands somewhere earlier as well."""
    e = Enhanced(segments, min_len)
    number, _ = _numbers(place)
    at = e.sa - e.starts[e.segment] + place["s"][e.segment]
    # Places that stand in two segments are one occurrence: they have one rank.
    by_place = np.lexsort((at, number[e.segment]))
    doc, at_ = number[e.segment][by_place], at[by_place]
    order = np.empty(len(e.sa), np.int64)
    order[by_place] = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (at_[1:] != at_[:-1])][: len(at_)])
    which, size = [], []
    rank = order.tolist()
    for length, _, _, heads, diverse in e.intervals(min_len, order):
        if diverse:
            first = min(map(rank.__getitem__, heads))
            for h in heads:
                if rank[h] != first:
                    which.append(h)
                    size.append(length)
    w = np.array(which, np.int64)
    found = [place[e.segment[w]]]
    found[0]["s"] = at[w]
    ends = [at[w] + np.array(size, np.int64)]
    # A segment with several places is a group by itself, as long as it is.
    for k, (x, known) in enumerate(zip(others, later.tolist(), strict=True)):
        if known:
            x = place[k : k + 1] if x is None else np.concatenate([place[k : k + 1], x])
        if x is not None:
            found.append(x)
            ends.append(x["s"] + len(segments[k]))
    return _joined(np.concatenate(found), np.concatenate(ends))


def _joined(place: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Spans from place to end, those of a document that overlap or touch as one."""
    number, firsts = _numbers(place) if len(place) else (np.empty(0, np.int64), np.empty(0, np.int64))
    far = number << 33
    lo, hi = far + place["s"], far + end
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.nonzero(np.r_[True, lo[1:] > reach[:-1]])[0] if len(lo) else order
    stop = np.r_[first[1:] - 1, len(lo) - 1] if len(lo) else first
    doc, low = place[firsts[lo[first] >> 33]], (1 << 33) - 1
    return pd.DataFrame({"doc": doc["doc"], "t1": doc["t1"], "t2": doc["t2"], "s": lo[first] & low, "e": reach[stop] & low})


_ANCHORED = "a long, v long, doc long, t1 long, t2 long, at long"
_MET = "kind byte, a long, doc long, t1 long, t2 long, s int, e int, others binary"


def _rows_by_anchor(min_len: int, gram: int):
    """Documents (doc, t1, t2, text) -> a row per run. at: the start, the number of strings and the
    kind side by side; of a SPAN row, v is the end."""

    def slab(held: list[tuple[int, int, int, int, bytes]]) -> Iterator[pd.DataFrame]:
        which, s, n, a, within = runs([x for *_, x in held], min_len, gram)
        if not len(which):
            return
        views = [memoryview(x) for *_, x in held]
        digest = xxhash.xxh3_64_intdigest
        v = np.array([digest(views[w][p : p + k]) for w, p, k in zip(which.tolist(), s.tolist(), (n + min_len - 1).tolist(), strict=True)], dtype=np.uint64)
        order = np.lexsort((v, a))  # rows stand in order of place, and equal runs stay so
        same = np.r_[False, (a[order][1:] == a[order][:-1]) & (v[order][1:] == v[order][:-1])]
        owner = np.array([x[:4] for x in held], np.int64)
        place = np.empty(len(which), PLACE)
        for k, name in enumerate(DOCUMENT):
            place[name] = owner[which, k]
        place["s"] = s + owner[which, 3]
        first = order[~same]
        at = (place["s"] << 22) | (n << 2) | np.where(within, SELF, PLAIN)
        yield pd.DataFrame({"a": a[first].view(np.int64), "v": v[first].view(np.int64)} | {c: place[c][first] for c in DOCUMENT} | {"at": at[first]})
        if not same.any():
            return
        # Runs that stand here more than once: their further places stay behind, as spans.
        kind = np.cumsum(~same) - 1
        several = np.unique(kind[same])
        cuts = np.searchsorted(kind[same], several)
        others = np.split(place[order[same]], cuts[1:])
        chosen = first[several].tolist()
        parts = [bytes(views[which[k]][s[k] : s[k] + n[k] + min_len - 1]) for k in chosen]
        spans = later_spans(parts, place[chosen], others, np.zeros(len(chosen), bool), min_len)
        key = (spans["t1"].to_numpy().view(np.uint64) + spans["s"].to_numpy().view(np.uint64)) * _STEP
        yield pd.DataFrame({"a": key.view(np.int64), "v": spans["e"], "doc": spans["doc"], "t1": spans["t1"], "t2": spans["t2"], "at": (spans["s"].to_numpy() << 22) | SPAN})

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(DOCUMENT, kind="stable").drop_duplicates(DOCUMENT)
            held: list[tuple[int, int, int, int, bytes]] = []
            size = 0
            for doc, t1, t2, text in zip(b["doc"], b["t1"], b["t2"], b["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in range(0, max(1, len(data) - min_len + 1), PIECE):
                    held.append((doc, t1, t2, p, data[p : p + PIECE + min_len - 1]))
                    size += len(held[-1][-1])
                    if size >= SLAB:
                        yield from slab(held)
                        held, size = [], 0
            if held:
                yield from slab(held)

    return run


def _meet(min_len: int, open_max: int, anchor_bytes: int):
    """Rows sorted by anchor, run bytes and place -> rows by document."""

    def told(kind: np.ndarray | int, a: np.ndarray, p: np.ndarray, end: np.ndarray, others: list) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "a": a, "doc": p["doc"], "t1": p["t1"], "t2": p["t2"], "s": p["s"], "e": end, "others": others})

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("a", "v", *DOCUMENT, "at")
        held = [np.empty(0, np.int64) for _ in names]
        last: tuple[int, ...] | None = None  # the row before, if its anchor goes on
        part = 0  # how many parts of an anchor have gone out

        def groups(rows: list[np.ndarray], going_on: bool) -> Iterator[pd.DataFrame]:
            """Whole anchors, or with going_on a part of one; the first may be the rest of one."""
            nonlocal part
            a, v, doc, t1, t2, at = rows
            if not len(a):
                return
            new_a = np.r_[last is None or a[0] != last[0], a[1:] != a[:-1]]
            new_v = new_a | np.r_[last is None or v[0] != last[1], v[1:] != v[:-1]]
            twin = ~new_v & np.r_[last is not None and (doc[0], t1[0], t2[0], at[0]) == last[2:], (doc[1:] == doc[:-1]) & (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1]) & (at[1:] == at[:-1])]
            rest = last is not None and a[0] == last[0]
            keep = ~twin
            a, v, at, new_a, new_v = a[keep], v[keep], at[keep], new_a[keep], new_v[keep]
            if not len(a):
                return
            place = np.empty(len(a), PLACE)
            place["doc"], place["t1"], place["t2"], place["s"] = doc[keep], t1[keep], t2[keep], at >> 22
            size = ((at >> 2) & 0xFFFFF) + min_len - 1
            later = not new_v[0]  # the first run began in an earlier part
            heads = np.nonzero(np.r_[True, new_v[1:]])[0]
            counts = np.diff(np.r_[heads, len(a)])
            anchors = np.nonzero(np.r_[True, new_a[1:]][heads])[0]  # as indices into heads
            kinds = np.diff(np.r_[anchors, len(heads)])
            within = np.logical_or.reduceat((at[heads] & 3) == SELF, anchors)
            busy = (kinds > 1) | within | (np.maximum.reduceat(counts, anchors) > 1)
            over = (np.add.reduceat(size[heads], anchors) > anchor_bytes) & (kinds > 1)
            if rest or going_on:
                over[0 if rest else -1] = True
            busy |= over
            if not busy.any():
                return
            of = np.repeat(np.arange(len(anchors)), kinds)  # the anchor of each head
            wanted = busy[of] & (~over[of] | (counts > 1) | ((np.arange(len(heads)) == 0) & later))
            k = np.nonzero(wanted)[0]
            raw = place.tobytes()
            lo, hi = heads[k], heads[k] + np.minimum(counts[k], PLACES_MAX + 1)
            others = [raw[32 * (x + 1) : 32 * y] if y > x + 1 else None for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            # Of an anchor that is not held whole, a run with several places is a segment by itself.
            own = np.where(over[of[k]], ((a[lo].view(np.uint64) * _STEP ^ v[lo].view(np.uint64)) * _STEP + np.uint64(part)).view(np.int64), a[lo])
            alone = (kinds == 1) & ~within & ~over
            kind = np.where((k == 0) & later, LATER, np.where(alone[of[k]], SOLE, SEGMENT))
            yield told(kind, own, place[lo], place["s"][lo] + size[lo], others)
            # Places beyond what one segment lists: segments by themselves, each with its next ones.
            starts = [at for x in k[counts[k] > PLACES_MAX + 1].tolist() for at in range(heads[x] + PLACES_MAX + 1, heads[x] + counts[x], PLACES_MAX + 1)]
            if starts:
                lo = np.array(starts)
                stop = heads[np.searchsorted(heads, lo, side="right") - 1] + counts[np.searchsorted(heads, lo, side="right") - 1]
                hi = np.minimum(lo + PLACES_MAX + 1, stop)
                others = [raw[32 * (x + 1) : 32 * y] if y > x + 1 else None for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                own = ((a[lo].view(np.uint64) * _STEP ^ v[lo].view(np.uint64)) * _STEP ^ place["t1"][lo].view(np.uint64) + place["s"][lo].view(np.uint64)).view(np.int64)
                yield told(LATER, own, place[lo], place["s"][lo] + size[lo], others)
            k = np.nonzero(over[of] & ~((np.arange(len(heads)) == 0) & later))[0]
            if len(k):
                lo = heads[k]
                yield told(STRINGS, a[lo], place[lo], place["s"][lo] + size[lo], [None] * len(k))
            part += 1

        for b in batches:
            span = (b["at"].to_numpy() & 3) == SPAN
            if span.any():
                x = b[span]
                yield pd.DataFrame({"kind": REPEAT, "a": 0} | {c: x[c] for c in DOCUMENT} | {"s": x["at"].to_numpy() >> 22, "e": x["v"], "others": None})
                b = b[~span]
            rows = [np.concatenate([h, b[c].to_numpy()]) for h, c in zip(held, names, strict=True)]
            a = rows[0]
            if not len(a):
                continue
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
            yield from groups([x[:cut] for x in rows], False)
            if cut:
                last, part = None, 0
            held = [x[cut:] for x in rows]
            if len(a) - cut > open_max:
                yield from groups(held, True)
                last = tuple(int(x[-1]) for x in held)
                held = [x[:0] for x in held]
        yield from groups(held, False)

    return run


def _moved(places: bytes, by: int) -> bytes:
    """The places, by so many bytes farther left."""
    out = np.frombuffer(places, PLACE).copy()
    out["s"] -= by
    return out.tobytes()


def _chained(sole: list, min_len: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(a, s, e, others) of segments of one document, those joined that go on in all their places."""
    a = s = e = others = None
    for x in sorted(sole, key=lambda x: x["s"]):
        if others is not None and x["s"] == e - min_len + 1 and x["e"] - s <= PIECE and len(x["others"]) == len(others):
            # Mostly there is one further place: its document first, then its start.
            if x["others"][:24] == others[:24] and _moved(x["others"], x["s"] - s) == others:
                e = x["e"]
                continue
        if others is not None:
            yield a, s, e, others
        a, s, e, others = x["a"], x["s"], x["e"], x["others"]
    if others is not None:
        yield a, s, e, others


def _cut(min_len: int):
    """Documents with what is asked of them, those of one document together -> segments (a, doc,
    t1, t2, s, later, part, others)."""
    columns = ["a", *DOCUMENT, "s", "later", "part", "others"]

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None

        def strings(cut: list[tuple[tuple[int, int, int], int, bytes]]) -> pd.DataFrame:
            """The strings of runs, equal ones as one segment."""
            found: dict[bytes, list[tuple[int, int, int, int]]] = {}
            for document, s, part in cut:
                for k in range(len(part) - min_len + 1):
                    found.setdefault(part[k : k + min_len], []).append((*document, s + k))
            rows = []
            for part, places in found.items():
                first, *rest = sorted(set(places))
                rows.append((xxhash.xxh3_64_intdigest(part) - 2**63, *first, False, part, np.array(rest, PLACE).tobytes() if rest else None))
            return pd.DataFrame(rows, columns=columns)

        for b in batches:
            rows, cut, size = [], [], 0
            for *document, text, asked in zip(*(b[c] for c in (*DOCUMENT, "text", "asked")), strict=True):
                if (document := tuple(document)) == last:
                    continue  # a repeated row
                last = document
                data = text.encode("utf-8", "surrogatepass")
                whole = [(a, s, e, False, others) for a, s, e, others in _chained([x for x in asked if x["kind"] == SOLE], min_len)]
                whole += [(x["a"], x["s"], x["e"], x["kind"] == LATER, x["others"]) for x in asked if x["kind"] in (SEGMENT, LATER)]
                for a, s, e, later, others in whole:
                    rows.append((a, *document, s, later, data[s:e], others))
                    size += e - s + len(others or b"")
                    if size > 4 * BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                for x in asked:
                    if x["kind"] != STRINGS:
                        continue
                    cut.append((document, x["s"], data[x["s"] : x["e"]]))
                    if sum(len(p) for *_, p in cut) > BATCH // 16:
                        yield strings(cut)
                        cut = []
            if cut:
                yield strings(cut)
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return run


def _scan(min_len: int):
    """Segments sorted by anchor and place -> the spans to remove."""

    key = ["a", *DOCUMENT, "s"]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        again = rows.duplicated(key)
        if again.any():  # a document that comes in several rows asks several times
            others = rows.groupby(key, sort=False)["others"].agg(lambda x: b"".join(y for y in x if y) or None)
            rows = rows[~again].assign(others=others.to_numpy())
        place = np.empty(len(rows), PLACE)
        for c in PLACE.names:
            place[c] = rows[c]
        others = [np.frombuffer(x, PLACE) if x else None for x in rows["others"]]
        return later_spans(rows["part"].tolist(), place, others, rows["later"].to_numpy(bool), min_len)

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def weights(rows: pd.DataFrame) -> np.ndarray:
            return np.fromiter((len(p) + len(o or b"") for p, o in zip(rows["part"], rows["others"], strict=True)), np.int64, len(rows))

        for b in batches:
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            lengths = np.cumsum(weights(rows))
            if lengths[-1] < BATCH:
                held = rows
                continue
            a = rows["a"].to_numpy()
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            lo = 0
            while lo < cut:  # whole anchors, about BATCH bytes at a time
                k = int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + BATCH))
                hi = int(np.searchsorted(a, a[min(k, cut - 1)], side="right"))
                yield solve(rows.iloc[lo:hi])
                lo = hi
            held = rows.iloc[cut:]
            if lengths[-1] - (lengths[cut - 1] if cut else 0) > 4 * BATCH:
                # More than any anchor of runs holds: one string's places. The first goes on with the rest.
                yield solve(held)
                held = held.iloc[:1].assign(others=None)
        if held is not None and len(held):
            yield solve(held)

    return run


def _remove(columns: list[str]):
    def merged(spans: list) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
        return out

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, *lists in zip(b["doc"], b["text"], b["spans"], b["more"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                spans = merged([(x["s"], x["e"]) for some in lists if some is not None for x in some])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                rest = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            yield pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])[columns]

    return run


def _told(by_anchor: DataFrame, min_len: int, open_max: int, anchor_bytes: int) -> DataFrame:
    """What the anchors ask of each document (doc, t1, t2, told)."""
    width = shuffle_width(by_anchor.sparkSession)
    met = by_anchor.repartition(width, "a").sortWithinPartitions("a", "v", *DOCUMENT, "at").mapInPandas(_meet(min_len, open_max, anchor_bytes), _MET)
    return met.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("kind", "a", "s", "e", "others")).alias("told"))


def _segments(docs: DataFrame, told: DataFrame, min_len: int) -> DataFrame:
    """The segments (a, doc, t1, t2, s, later, part, others), sorted by anchor and place."""
    asked = told.select(*DOCUMENT, F.filter("told", lambda x: x["kind"] != REPEAT).alias("asked")).where(F.size("asked") > 0)
    # Every column of docs goes in, so that this join and the last one share docs' exchange.
    cut = docs.join(asked, DOCUMENT).mapInPandas(_cut(min_len), "a long, doc long, t1 long, t2 long, s int, later boolean, part binary, others binary")
    return cut.repartition(shuffle_width(docs.sparkSession), "a").sortWithinPartitions("a", *DOCUMENT, "s")


def _identity(text: Column) -> list[Column]:
    return [sealed("doc_id").alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _marked(docs: DataFrame, min_len: int, gram: int, open_max: int, anchor_bytes: int) -> DataFrame:
    """docs (doc, t1, t2, text, ...) with spans and more: lists of (s, e) or null."""
    by_anchor = docs.select(*DOCUMENT, "text").mapInPandas(_rows_by_anchor(min_len, gram), _ANCHORED)
    told = _told(by_anchor, min_len, open_max, anchor_bytes)
    found = _segments(docs, told, min_len).mapInPandas(_scan(min_len), "doc long, t1 long, t2 long, s int, e int")
    more = found.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("s", "e")).alias("more"))
    spans = told.select(*DOCUMENT, F.transform(F.filter("told", lambda x: x["kind"] == REPEAT), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans"))
    return docs.join(spans, DOCUMENT, "left").join(more, DOCUMENT, "left")


def remove_repeats(df: DataFrame, min_len: int = MIN, gram: int = GRAM, open_max: int = OPEN_MAX, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of (doc_id, text)."""
    columns = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    text = text_or_empty("text").cast("string")
    docs = df.select(*_identity(text), text.alias("text"))
    out = _marked(docs, min_len, gram, open_max, anchor_bytes).mapInPandas(_remove(columns), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(unsealed("doc").alias("doc_id"), *columns[1:])


def without_repeats(df: DataFrame, min_len: int = MIN, gram: int = GRAM, open_max: int = OPEN_MAX, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """df's own columns, text without its later repeats and n_chars, if there, to match.

    A cut that leaves bytes which are not UTF-8 keeps what is whole of each character. Rows
    whose text loses nothing stay as they are, a null text included; of rows that agree in
    doc_id and text each is changed alike."""
    inner = _remove(["n_removed", "kept"])

    @released
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            b = pd.DataFrame(dict(zip(("text", "spans", "more"), columns, strict=True)))
            some = b["text"].notna()
            new = pd.Series([None] * len(b), dtype=object)
            if some.any():
                out = next(iter(inner(iter([b[some].assign(doc=0)]))))
                new[some.to_numpy()] = [x.decode("utf-8", "ignore") if n else None for n, x in zip(out["n_removed"], out["kept"], strict=True)]
            yield new

    text = text_or_empty("text").cast("string")
    # Columns go under numbers, so that none clashes; a text is told from a null by a mark of its own.
    own = {c: f"c{k}" for k, c in enumerate(df.columns) if c != "text"}
    docs = df.select(*_identity(text), text.alias("text"), F.col("text").isNull().alias("none"), *(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    marked = _marked(docs, min_len, gram, open_max, anchor_bytes)
    touched = F.col("spans").isNotNull() | F.col("more").isNotNull()
    d = marked.withColumn("new", F.pandas_udf(cut, "string")(F.when(touched, F.col("text")), "spans", "more"))
    out = {c: F.col(n) for c, n in own.items()} | {"text": F.when(~F.col("none"), F.coalesce("new", "text"))}
    if "n_chars" in own:
        out["n_chars"] = F.when(F.col("new").isNull(), F.col(own["n_chars"])).otherwise(F.length("new"))
    return d.select(*(out[c].alias(c) for c in df.columns))
