from __future__ import annotations

import os
import random
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
import sentencepiece

from lantern.llm import pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec.of(pieces._default_model())


def texts(seed, n=1500):
    r = random.Random(seed)
    odd = ["", " ", "   ", " a", "a ", "▁", "▁▁x ", "<s>foo</s>", "<unk>", "日本語 テスト", "\x00a", "a" * 70, " " * 40 + "x", "<0x41>", "\U0001f600\U0001f600 x"]
    return odd + ["".join(r.choice("aeiou  thn\nñ世é<>▁") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_other_library(codec):
    t = texts(3)
    done = codec.encode(t)
    for x, (ids, same), back in zip(t, done, codec.decode([i for i, _ in done]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == codec.other.encode(x) and same
        assert back == codec.other.decode(codec.other.encode(x))


def test_decoding_of_any_ids(codec):
    r = random.Random(6)
    some = [k for k, (_, _, t) in enumerate(codec.model.pieces) if t != pieces.BYTE]
    for ids in [[], [codec.model.unknown], [1, 2], *([r.choice([codec.model.unknown, 1, 2, *r.choices(some, k=9)]) for _ in range(12)] for _ in range(300))]:
        assert codec.decode([np.array(ids, "<u4").tobytes()]) == [codec.other.decode(ids)]


class Other:
    """A stand-in for the checking library that is wrong about one word."""

    def __init__(self, real):
        self.real = real

    def encode(self, texts, num_threads=1):
        return [[5] if "wrong" in x else ids for x, ids in zip(texts, self.real.encode(texts), strict=True)]


def test_ids_are_the_pipelines_own_and_the_other_only_checks(codec):
    with open(pieces._default_model(), "rb") as f:
        own = pieces.Codec(f.read())
    own.other = Other(own.other)
    t = ["all is well here", "a wrong word", "all is wrong", ""]
    for x, (ids, same), (want, _) in zip(t, own.encode(t), codec.encode(t), strict=True):
        assert ids == want and np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(x, add_special_tokens=False).ids
        assert same == ("wrong" not in x)


def test_batches_run_on_threads():
    """In a fresh process, as a worker is: the library's own threads are there after a batch."""
    code = (
        "import os; from lantern.llm import pieces; c = pieces.Codec.of(pieces._default_model()); n = lambda: len(os.listdir('/proc/self/task'));"
        "a = n(); c.encode([f'w{k} x{k}y' for k in range(3000)]); print(n() - a)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if "RAYON" not in k and "TOKENIZERS" not in k})
    assert int(out.stdout) >= pieces.THREADS


def field(number, kind, payload):
    key = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
    return key + (bytes([len(payload)]) + payload if kind == 2 else payload)


def unigram():
    """A small unigram model put together by hand, field by field."""
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    vocab += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("▁a", -3.5), ("ab", -3.2), ("▁ab", -6.9), ("aba", -5.1), ("b▁a", -4.0), ("c", -6.0))]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))) for p, s, t in vocab)
    trainer = field(3, 0, b"\x01") + field(35, 0, b"\x01")
    normaliser = field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01")
    return data + field(2, 2, trainer) + field(3, 2, normaliser)


def test_a_unigram_model():
    data = unigram()
    own = pieces.Codec(data)
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert own.model.kind == pieces.UNIGRAM and not own.model.by_word
    r = random.Random(4)
    for x in ["", "abab", "ab a", "é", *("".join(r.choice("ab c") for _ in range(r.randint(1, 25))) for _ in range(300))]:
        ids, same = own.encode([x])[0]
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(x) and own.decode([ids]) == [x]
        assert same


def test_the_query_on_a_unigram_model(spark, tmp_path, edge_docs):
    (tmp_path / "u.model").write_bytes(unigram())
    other = sentencepiece.SentencePieceProcessor(model_proto=unigram())
    texts = {r["doc_id"]: r["text"] or "" for r in edge_docs.where("doc_id < 25").collect()}
    rows = pieces.encode(edge_docs.where("doc_id < 25"), str(tmp_path / "u.model"), keep_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {d: other.encode(t) for d, t in texts.items()}
    assert all(r["parity"] and r["round_trip"] for r in rows)


def test_the_whole_query(spark, small):
    """Every row against the other library, text by text."""
    from lantern.llm import queries

    other = sentencepiece.SentencePieceProcessor(model_file=pieces._default_model())
    want = {}
    for r in small.select("doc_id", "text").collect():
        ids = other.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True, True)
    got = queries.op4_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_ids"], r["ids_crc32"], r["parity"], r["round_trip"]) for r in got} == want and len(got) == len(want)


def test_operator(spark, codec, edge_docs, no_docs):
    rows = pieces.encode(edge_docs, keep_ids=True)
    got = rows.collect()
    assert len(got) == edge_docs.count() and all(r["parity"] and r["round_trip"] for r in got)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_ids"] == len(r["ids"]) for r in got)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows.where("doc_id is not null")).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in edge_docs.where("doc_id is not null").collect())
    assert pieces.encode(no_docs).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] == ""
