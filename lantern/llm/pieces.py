"""SentencePiece encoding and decoding on the Tokenizers library.

The model protobuf is read field by field. Out of it come the normaliser (the character
map, white-space rules and dummy prefix), the metaspace marker, the vocabulary with its
scores (Viterbi over piece scores for a unigram model, merges ranked by score for a BPE
model) and byte fallback, put together as a Tokenizers pipeline. Its ids are the result, and
its decoder turns them back into text; both run in batches over THREADS threads.

If no piece has a marker behind another character, no piece crosses from one word to the
next, and a text is encoded word by word: new words go to the pipeline in batches and are
remembered (MEMO of them at most; a full memo is emptied, and each task starts with an empty
one). Each new word is also encoded by the sentencepiece library, which only checks: parity
is false for a text that holds a word on which the two differ. Other models are encoded and
compared text by text.

Cases: a null text is encoded as empty; a null doc_id stays null. A very long text goes in
portions that begin at a space before a letter, where a word begins. Control strings in a
text are ordinary text. A text that holds the marker itself comes back with spaces in its
place and counts as a round trip to its normalised form. There are no ties: a row's result
depends on its text alone, so repeated rows give repeated results. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import released, sealed, unsealed
from lantern.llm.packing import PORTION, portions

MARK = "▁"
MEMO = 400_000
#: Threads of the tokenizer in a worker, unless RAYON_NUM_THREADS says otherwise.
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-width values as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
            yield key >> 3, value
            continue
        if kind == 2:
            size, at = varint(at)
        else:
            size = {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """What encoding needs of a model file."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = bytes(normaliser.get(2, b""))
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.unknown = next(k for k, (*_, t) in enumerate(self.pieces) if t == UNKNOWN)
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0) or any(t == USER for *_, t in self.pieces):
            raise ValueError("only unigram and BPE models with the marker in front and without user-defined pieces")

    @cached_property
    def by_word(self) -> bool:
        """Whether every piece stays within a word, so that words are encoded on their own."""
        return self.dummy_prefix and not self.charsmap and not self.squeeze and not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put a piece together from two others, best score first."""
        normal = {p: k for k, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        ranked = []
        for p, k in normal.items():
            parts = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in normal and p[i:] in normal]
            ranked += [(-self.pieces[k][1], k, normal[a], normal[b], a, b) for a, b in parts]
        ranked.sort()
        return [(a, b) for *_, a, b in ranked]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == UNIGRAM:
            # Pieces that a text may not use score below any path, so that only their ids count.
            low = min(s for _, s, _ in self.pieces) - 1e4
            vocab = [(p, s if t == NORMAL else low) for p, s, t in self.pieces]
            inner = models.Unigram(vocab, unk_id=self.unknown, byte_fallback=self.byte_fallback)
        else:
            vocab = {p: k for k, (p, *_) in enumerate(self.pieces)}
            inner = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        t = Tokenizer(inner)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
        if self.by_word:
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
        return t


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


class Codec:
    """encode and decode whole texts; ids as little-endian uint32 bytes."""

    _made: dict[str, Codec] = {}

    def __init__(self, data: bytes):
        # Read by the library when it first runs a batch in this process.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece

        self.model = Model(data)
        self.tokenizer = self.model.tokenizer()
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.memo: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        pieces = self.model.pieces
        names = [p for p, *_ in pieces]
        self.opens = np.array([p.startswith(MARK) for p in names])
        self.spaced = self.opens | np.array([t == BYTE and p == "<0x20>" for p, _, t in pieces])
        self.control = np.array([t == CONTROL for *_, t in pieces])
        self.mark = np.array([names.index(MARK) if MARK in names else self.model.unknown], "<u4").tobytes()

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            with open(path, "rb") as f:
                cls._made[path] = cls(f.read())
        return cls._made[path]

    def _both(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of texts as they are, and whether the other library has the same."""
        mine = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        theirs = self.other.encode(texts, num_threads=THREADS) if texts else []
        return [(np.array(a.ids, "<u4").tobytes(), a.ids == b) for a, b in zip(mine, theirs, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        if not self.model.by_word:
            return self._both(texts)
        if any(len(x) > PORTION for x in texts):
            return [self._long(x) for x in texts]
        return self._words([_WORDS(MARK + x.replace(" ", MARK)) if x else [] for x in texts])

    def _long(self, text: str) -> tuple[bytes, bool]:
        """A text part by part; a part but the first begins with the space before a letter."""
        done = [self._words([_WORDS(MARK * (k == 0 and bool(text)) + p.replace(" ", MARK))])[0] for k, p in enumerate(portions(text))]
        return b"".join(ids for ids, _ in done), all(same for _, same in done)

    def _words(self, words: list[list[str]]) -> list[tuple[bytes, bool]]:
        new = set().union(*words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*words)
        self._learn(sorted(new))
        self.memo[""] = b""
        return [(b"".join(itemgetter(*w, "")(self.memo)), not self.wrong or self.wrong.isdisjoint(w)) for w in words]

    def _alone(self, words: list[str]) -> None:
        for w, (ids, same) in zip(words, self._both([w[1:].replace(MARK, " ") for w in words]), strict=True):
            # A marker alone is the empty text to either library; it is the marker's own piece here.
            self.memo[w] = ids if w != MARK else self.mark
            if not same:
                self.wrong.add(w)

    def _learn(self, new: list[str]) -> None:
        """Ids of words. Words with one marker in front go many at a time: a piece that starts with a
        marker begins the next word."""
        self._alone([w for w in new if len(w) == 1 or w[1] == MARK])
        others = [w for w in new if len(w) > 1 and w[1] != MARK]
        parts = [others[k : k + 500] for k in range(0, len(others), 500)]
        texts = [" ".join(w[1:] for w in p) for p in parts]
        theirs = self.other.encode(texts, num_threads=THREADS) if texts else []
        for part, mine, check in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), theirs, strict=True):
            ids = self._cut(np.array(mine.ids, "<u4"))
            if len(ids) != len(part):  # a word that does not begin with a marker's piece
                self._alone(part)
                continue
            self.memo.update(zip(part, ids, strict=True))
            if mine.ids != check:
                cut = self._cut(np.array(check, "<u4"))
                if len(cut) != len(part):
                    self._alone(part)
                else:
                    self.wrong.update(w for w, a, b in zip(part, ids, cut, strict=True) if a != b)

    def _cut(self, ids: np.ndarray) -> list[bytes]:
        data = ids.tobytes()
        at = [*np.nonzero(self.opens[ids])[0].tolist(), len(ids)]
        return [data[4 * lo : 4 * hi] for lo, hi in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids: the pipeline's decoder over the runs between unknown pieces. Control pieces have no text."""
        runs: list[list[int]] = []
        spaces: list[str] = []
        counts = []
        for data in ids:
            x = np.frombuffer(data, "<u4")
            x = x[~self.control[x]]
            parts = np.split(x, np.nonzero(x == self.model.unknown)[0]) if (x == self.model.unknown).any() else [x]
            for k, p in enumerate(parts):
                p = p[1:] if k else p
                runs.append(p.tolist())
                # The decoder takes a space off the front of what it is given: right for a text's alone.
                spaces.append(" " if len(p) and self.spaced[p[0]] and (k or not self.model.dummy_prefix) else "")
            counts.append(len(parts))
        done = iter([s + t for s, t in zip(spaces, self.tokenizer.decode_batch(runs, skip_special_tokens=False), strict=True)])
        return [" ⁇ ".join(next(done) for _ in range(n)) for n in counts]


def _default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, parity, round_trip of every text, and the ids if asked for."""
    path = model or _default_model()

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path)
        for b in batches:
            for lo in range(0, len(b), 512):
                texts = [x or "" for x in b["text"].iloc[lo : lo + 512]]
                done = codec.encode(texts)
                out = {
                    "doc_id": b["doc_id"].to_numpy()[lo : lo + 512], "n_ids": [len(i) // 4 for i, _ in done], "ids_crc32": [zlib.crc32(i) for i, _ in done],
                    "parity": [same for _, same in done], "round_trip": [t == x.replace(MARK, " ") for t, x in zip(codec.decode([i for i, _ in done]), texts, strict=True)],
                }
                if keep_ids:
                    out["ids"] = [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in done]
                yield pd.DataFrame(out)
        codec.memo.clear()

    schema = "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * keep_ids
    out = df.select(sealed("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)
    return out.withColumn("doc_id", unsealed("doc_id"))


def decode(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids); null ids give an empty text."""
    path = model or _default_model()

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path)
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.iloc[lo : lo + 512]
                text = codec.decode([np.asarray(x if x is not None else [], "<u4").tobytes() for x in part["ids"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "text": text})

    out = df.select(sealed("doc_id").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInPandas(run, "doc_id long, text string")
    return out.withColumn("doc_id", unsealed("doc_id"))
