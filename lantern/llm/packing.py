"""Best-fit packing of tokenised documents by hierarchical residual packing.

A document becomes its byte-level BPE ids followed by one end id. A document that
is longer than a sequence is cut from its end into full pieces, so only its first
piece may be shorter. Pieces are dealt into shards of bounded size; each shard is
packed best-fit (largest piece first, into the fullest sequence that holds it).
Sequences that come out nearly full are emitted. The others travel on, each as one
item as long as its filling, to fewer shards, where they are packed best-fit again:
a tree of merges that ends with a single shard, or when a round saves nothing more.
Shards are dealt by a hash with a salt for each row, so equal rows spread like any others,
and there are as many as keep a shard near SHARD_ROWS pieces: no task holds many more.

Cases: a null text counts as empty (one piece, the end id alone). Repeated rows and
null doc_ids are packed like any other row. Ties between pieces of one length go by
doc_id (null first), then piece. An empty table gives an empty result. Extra columns
are ignored. A very long text is cut, never shortened.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import checkpoint, released, sealed, unsealed

SEQUENCE = 2048
END_ID = 0
SHARD_ROWS = 40_000
#: A sequence with at most this many free places is emitted without another round.
NEARLY_FULL = 4
MEMO = 400_000
#: New pre-tokens that go to the tokenizer in one call.
LEARNED = 16_000
#: Of these, those that stand together in a line: each line costs the tokenizer something of its own.
LINE = 32

#: Texts of these characters alone are split into pre-tokens here; others go whole
#: to the tokenizer. On these characters the pattern is the tokenizer's own.
_ODD = re.compile("[^ -~\nÀ-ÖØ-öø-ÿ]").search
_PRETOKENS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+").findall


#: Characters of a text that are encoded at once.
PORTION = 1 << 20
_BREAK = re.compile(" (?=[A-Za-z])").search


def portions(text: str) -> list[str]:
    """A long text in parts that are encoded on their own: a space before a letter begins a pre-token."""
    out, at = [], 0
    while len(text) - at > PORTION and (m := _BREAK(text, at + PORTION)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def _default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids of whole texts as little-endian uint32 bytes, equal to the tokenizer's own.

    A pre-token is encoded by the tokenizer once and remembered, up to MEMO of them;
    a full memo is emptied and refilled, and each task starts with an empty one, so that an idle
    worker holds none."""

    _made: dict[str, Encoder] = {}

    def __init__(self, model: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(model)
        self.memo: dict[str, bytes] = {}
        # The same model behind a plain split at newlines, for pre-tokens in its own alphabet of
        # one character per byte: printable Latin-1 stands for itself, other bytes for 256 upwards.
        self.inner = Tokenizer(self.tokenizer.model)
        self.inner.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = (b for b in range(256) if b not in printable)
        self.shown = {b: chr(256 + k) for k, b in enumerate(others) if b != 10}
        self.alphabet = "".join(self.shown.get(b, chr(b)) for b in range(256))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.newline = chr(256 + list(b for b in range(256) if b not in printable).index(10))
        self.newline_id = vocabulary[self.newline]
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[k for token, k in vocabulary.items() if token.startswith(self.shown[32])]] = True

    @classmethod
    def of(cls, model: str) -> Encoder:
        if model not in cls._made:
            cls._made[model] = cls(model)
        return cls._made[model]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Many pre-tokens go in one call, in lines; none of them holds a newline."""
        spaced, bare = [], []
        for w in new:
            if w[0] == " " and len(w) > 1 and w[1] not in " \n":
                spaced.append(w)  # its first id is of a token that starts with a space, and no other is
            elif w[0] in " \n":
                self.memo[w] = self._ids(w)
            else:
                bare.append(w)
        for words in (spaced, bare):
            for k in range(0, len(words), LEARNED):
                part = words[k : k + LEARNED]
                # Nothing is merged with a space behind it, so those with one can share a line.
                lines = ["".join(part[j : j + LINE]) for j in range(0, len(part), LINE)] if words is spaced else part
                text = codecs.charmap_decode("\n".join(lines).encode(), "strict", self.alphabet)[0]
                if words is bare:
                    text = text.replace("\n", f"\n{self.newline}\n")
                # One text a call: several are dealt to threads, whose waiting costs more CPU than the work.
                ids = np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                if words is spaced:
                    lo = np.nonzero(self.opens[ids])[0].tolist()
                    hi = [*lo[1:], len(ids)]
                else:  # a newline's own id stands between
                    hi = [*np.nonzero(ids == self.newline_id)[0].tolist(), len(ids)]
                    lo = [0, *(k + 1 for k in hi[:-1])]
                data = ids.tobytes()
                self.memo.update((w, data[4 * a : 4 * b]) for w, a, b in zip(part, lo, hi, strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        if any(len(x) > PORTION for x in texts):
            return [b"".join(self._batch([p])[0] for p in portions(x)) for x in texts]
        return self._batch(texts)

    def _batch(self, texts: list[str]) -> list[bytes]:
        plain = [None if _ODD(x) or "<|" in x else _PRETOKENS(x) for x in texts]
        new = set().union(*(x for x in plain if x)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*(x for x in plain if x))
        self._learn(new)
        self.memo[""] = b""
        return [self._ids(x) if p is None else b"".join(itemgetter(*p, "")(self.memo)) for x, p in zip(texts, plain, strict=True)]


def tokenize(df: DataFrame, model: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every text."""
    model = model or _default_model()
    tail = np.array([END_ID], "<u4").tobytes()

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(model)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                rows = []
                for doc, ids in zip(part["doc_id"], encoder.batch([x or "" for x in part["text"]]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    first = n % size or min(n, size)
                    ends = range(first, n + 1, size)
                    for piece, end in enumerate(ends):
                        start = 0 if piece == 0 else end - size
                        rows.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out
        encoder.memo.clear()

    return df.select(sealed("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, items taken in the order given: the fullest bin that holds
    it, the oldest of equals, else a new one. A bit mask over free places finds it."""
    free: dict[int, list[int]] = {}
    mask = 0
    bins = 0
    out = []
    for s in sizes:
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            stack = free[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        out.append(b)
        room -= s
        if room:
            free.setdefault(room, []).append(b)
            mask |= 1 << room
    return out


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, filled long, open boolean"


def _pack_shard(level: int, size: int, slack: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # At first every piece is an item; later the pieces of one stand together in their order.
        order = ["doc_id", "piece", "ids_crc32", "bin"] if level == 0 else ["bin", "offset"]
        rows = rows.sort_values(["filled", *order], ascending=[False] + [True] * len(order), kind="stable")
        lead = (rows["offset"] == 0).to_numpy()
        item = np.cumsum(lead) - 1  # the pieces of one item stand together, its first at offset 0
        sizes = rows["filled"].to_numpy()[lead]
        bins = np.array(best_fit(sizes.tolist(), size), dtype=np.int64)
        order = np.argsort(bins, kind="stable")
        base = np.empty(len(sizes), dtype=np.int64)
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        filled = np.bincount(bins, weights=sizes).astype(np.int64)
        at = bins[item]
        rows["offset"] = rows["offset"].to_numpy() + base[item]
        rows["filled"] = filled[at]
        rows["open"] = filled[at] < size - slack
        rows["bin"] = (((level << 28) | int(key[0])) << 30) | at
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "filled", "open"]]

    return run


def merged_shards(shards: int, rows: int, left: int, shard_rows: int) -> int | None:
    """How many shards the pieces left go on in; None where another round cannot help: nothing
    is left, what is left needs as many shards, or under a tenth was emitted."""
    fewer = max(1, -(-left // shard_rows))
    return fewer if left and fewer < shards and left <= 0.9 * rows else None


def pack(pieces: DataFrame, size: int = SEQUENCE, slack: int = NEARLY_FULL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. Emitted sequences hold at most size tokens."""
    # Numbered before the checkpoint: a lost task cannot deal its rows anew behind it.
    pieces = checkpoint(pieces.withColumn("salt", F.monotonically_increasing_id()))
    rows = pieces.count()
    shards = max(1, -(-rows // shard_rows))
    todo = pieces.select(
        *(c for c in pieces.columns if c != "salt"),
        # A piece is an item of its own: bin tells it from all others until it has been packed.
        F.col("salt").alias("bin"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("filled"), F.lit(True).alias("open"),
    )
    done = None
    level = 0
    while True:
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(shards)))
        packed = checkpoint(dealt.groupBy("shard").applyInPandas(_pack_shard(level, size, slack), _PACKED))
        rest = packed.where("open")
        left = rest.count() if shards > 1 else 0
        fewer = merged_shards(shards, rows, left, shard_rows)
        final, rest = (packed, None) if fewer is None else (packed.where("not open"), rest)
        done = final if done is None else done.unionByName(final)
        if fewer is None:
            break
        rows, shards, todo, level = left, fewer, rest, level + 1
    return done.select(unsealed("doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, model: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(tokenize(df, model, size), size)
