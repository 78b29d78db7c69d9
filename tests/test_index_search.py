from __future__ import annotations

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lantern import cli
from lantern.functions import fixed
from lantern.operators import cache, expand, fragments, index, present, search
from lantern.sources import files
from lantern.streaming import incremental


def docs_of(spark, texts):
    rows = [(k, f"/d/doc_{k}.txt", f"doc_{k}.txt", ".txt", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, path string, title string, type string, text string")


def split_sentences(data: bytes) -> list[str]:
    out, start = [], 0
    for i, c in enumerate(data):
        if c in b".!?;\n" and i + 1 - start >= 80:
            out.append(data[start : i + 1])
            start = i + 1
    return [s for x in [*out, data[start:]] if (s := x.decode().strip(" \t\r\n\f\v"))]


def test_sentences_by_bytes(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab é.!;\nя ") for _ in range(r.randint(0, 600))) for _ in range(60)]
    rows = docs_of(spark, texts).select("doc_id", fragments.sentences(F.col("text")).alias("s")).collect()
    assert all(x["s"] == split_sentences(texts[x["doc_id"]].encode()) for x in rows)


def test_packing_limits(spark):
    r = random.Random(2)
    words = lambda n: " ".join("слово" if r.random() < 0.3 else "word" for _ in range(n))
    texts = [f"{words(50)}.\n\n{words(400)}\n \n{words(100)}.", "x" * 1400, "x" * 1401, "é" * 1500, "", "  \n\n "]
    rows = {x["doc_id"]: x["f"] for x in docs_of(spark, texts).select("doc_id", fragments.content_fragments(F.col("text")).alias("f")).collect()}
    assert all(len(p.encode()) <= fixed.FRAGMENT_BYTES for f in rows.values() for p in f)
    assert rows[1] == ["x" * 1400] and rows[2] == ["x" * 1400, "x"] and [len(p) for p in rows[3]] == [700, 700, 100] and rows[4] == rows[5] == []
    assert " ".join(" ".join(rows[0]).split()) == " ".join(texts[0].split())


def test_segments_follow_the_sequential_rule(spark):
    r = random.Random(3)
    for counts in ([1] * 300, [r.choice([1, 1, 5, 40, 385, 500]) for _ in range(400)], [0, 0, 384, 1], [], [7]):
        df = spark.createDataFrame(list(enumerate(counts)), "doc_id long, fragment_count long")
        got = {x["doc_id"]: x["segment_id"] for x in fragments.assign_segments(df).collect()}
        want, seg, d, f = {}, -1, 0, 0
        for k, n in enumerate(counts):
            if seg < 0 or d >= 64 or f + n > 384:
                seg, d, f = seg + 1, 0, 0
            want[k], d, f = seg, d + 1, f + n
        assert got == want


@pytest.fixture(scope="module")
def small(spark):
    texts = [
        "Search engines rank documents. " * 4, "The customer pays a price for the contract.", "", None, "Договор поставки: цена и срок оплаты.",
        "penalty liability deadline", "searching serch engine ranking",
    ]
    return index.build(docs_of(spark, texts), numbered=True)


def test_index_invariants(small):
    d = {r["doc_id"]: r for r in small.documents.collect()}
    f = small.fragments.collect()
    assert len(d) == 7 and all(d[k]["fragment_count"] >= 1 for k in d)
    assert all(sum(x["length"] for x in f if x["doc_id"] == k) == d[k]["length"] for k in d)
    assert sorted(x["fragment_id"] for x in f) == list(range(len(f)))
    assert small.postings.agg(F.sum("tf")).first()[0] == sum(x["length"] for x in f)
    assert all(x["metadata_only"] == (x["ordinal"] == 0) for x in f)
    assert "OCR" in next(x["text"] for x in f if x["doc_id"] == 2 and x["ordinal"] == 0)


def test_search_batch_equals_single_queries_and_a_plain_computation(spark, small):
    asked = [(1, "contract price"), (2, "serch engine"), (3, "и"), (4, "zzzz"), (5, "penalty deadline")]
    q = spark.createDataFrame(asked, "qid long, text string")
    got = {}
    for r in search.search(small, q, 3).collect():
        got.setdefault(r["qid"], []).append((r["place"], r["fragment_id"], round(r["score"], 9)))
    assert 3 not in got and set(got) >= {1, 2, 5}
    for qid, text in asked:
        one = search.search(small, spark.createDataFrame([(qid, text)], "qid long, text string"), 3).collect()
        assert sorted(got.get(qid, [])) == sorted((r["place"], r["fragment_id"], round(r["score"], 9)) for r in one)
    raw = search.score_docs(small, expand.expand(expand.base_terms(q.where("qid = 5")), None)).collect()
    docs = {r["doc_id"]: r["length"] for r in small.documents.collect()}
    posts = {}
    for r in small.doc_postings.collect():
        posts.setdefault(r["term"], {})[r["doc_id"]] = r["tf"]
    mean, want = sum(docs.values()) / len(docs), {}
    for r in expand.expand(expand.base_terms(q.where("qid = 5")), None).collect():
        hits = posts.get(r["term"], {})
        idf = math.log(1 + (len(docs) - len(hits) + 0.5) / (len(hits) + 0.5))
        for k, tf in hits.items():
            want[k] = want.get(k, 0) + r["weight"] * idf * tf * 2.45 / (tf + 1.45 * (1 - 0.72 + 0.72 * docs[k] / mean))
    assert {r["doc_id"]: round(r["score"], 9) for r in raw} == {k: round(v, 9) for k, v in want.items()}


def test_fuzzy_weights_and_limits(spark, small):
    q = spark.createDataFrame([(1, "serch enginn penalti")], "qid long, text string")
    rows = expand.fuzzy_expand(expand.base_terms(q), small.vocab_grams).collect()
    assert {r["weight"] for r in rows} <= {0.5, 0.36} and {"engin", "penalty"} <= {r["term"] for r in rows}


def test_presentation(spark, small):
    q = spark.createDataFrame([(1, "contract price")], "qid long, text string")
    found = search.search(small, q, 5)
    shown = present.present(small, q, found, colour=True).orderBy("place").collect()
    assert shown and present.MARK in shown[0]["snippet"] and "#f" in shown[0]["source"]
    assert present.answers(small, q, found).count() == min(5, len(shown))
    text = "я" * 300 + " contract " + "b" * 900
    cut = present.snippet(text, {"contract"})
    assert cut.startswith("...") and cut.endswith("...") and "contract" in cut and len(cut.encode()) <= 650


def test_save_and_load(spark, small, tmp_path):
    small.save(str(tmp_path / "ix"))
    again = index.Index.load(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "contract price")], "qid long, text string")
    key = lambda ix: sorted((r["place"], r["fragment_id"], round(r["score"], 9)) for r in search.search(ix, q, 5).collect())
    assert key(again) == key(small) and again.counts() == small.counts()
    # The version before had no term tables: they are made from the postings.
    spark.createDataFrame([(4,)], "version int").write.mode("overwrite").parquet(str(tmp_path / "ix" / "meta"))
    old = index.Index.load(spark, str(tmp_path / "ix"))
    assert old.terms.exceptAll(small.terms).isEmpty() and old.vocab_grams.count() == small.vocab_grams.count()
    spark.createDataFrame([(3,)], "version int").write.mode("overwrite").parquet(str(tmp_path / "ix" / "meta"))
    with pytest.raises(ValueError):
        index.Index.load(spark, str(tmp_path / "ix"))


def write_folder(root):
    (root / "build").mkdir()
    (root / ".hidden").mkdir()
    (root / "a.txt").write_bytes("Договор номер 42".encode("cp1251"))
    (root / "b.MD").write_text("# Title\nsome *text* here")
    (root / "_x [1].text").write_text("underscore file")
    (root / "build" / "no.txt").write_text("skipped")
    (root / ".hidden" / "yes.txt").write_text("hidden directory")
    (root / "empty.txt").write_text("")
    (root / "other.bin").write_text("not read")
    with zipfile.ZipFile(root / "w.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p>main text</w:p>")
        z.writestr("word/footnotes.xml", "<w:p>a note</w:p>")
        z.writestr("word/styles.xml", "<w:p>style</w:p>")
    (root / "p.pdf").write_bytes(b"%PDF /Font BT (Hello \\(nested (deep)\\) w\\157rld of text) Tj <466f6f206261> ET")
    (root / "broken.docx").write_bytes(b"no archive")


def test_folder_source(spark, tmp_path):
    write_folder(tmp_path)
    got = {r["title"]: r["text"] for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.MD", "_x [1].text", "yes.txt", "empty.txt", "w.docx", "p.pdf", "broken.docx"}
    assert got["a.txt"] == "Договор номер 42" and got["b.MD"] == "Title\nsome text here\n" and "main text" in got["w.docx"] and "a note" in got["w.docx"]
    assert "style" not in got["w.docx"] and "Hello (nested (deep)) world of text Foo ba" in got["p.pdf"] and got["broken.docx"] == ""
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "none"))


def test_pdf_strings():
    assert files.pdf_literal(b"(a\\n\\101\\\r\nb\\z)", 0)[0] == "a\nAbz"
    assert files.pdf_hex(b"<FEFF 0416 1>", 0)[0] == "Ж" or files.pdf_hex(b"<41 4>", 0)[0] == "A@"
    assert files.pdf_plain_text(b"nothing (one literal here) (ab)") == "one literal here\n"


def test_cache_reuse(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("gone", 1, 1)], "rel_key string, size long, mtime long")
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 3), ("c", 1, 1)], "rel_key string, size long, mtime long")
    kept, todo = index.refresh_cache(now, old.withColumn("text", F.lit("t")), old)
    assert [r["rel_key"] for r in kept.collect()] == ["a"] and sorted(r["rel_key"] for r in todo.collect()) == ["b", "c"]


def test_folder_cache(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "cache")
    root.mkdir()
    write_folder(root)
    first, counts = cache.refresh(spark, str(root), store)
    cold = sorted(map(str, first.collect()))
    assert counts == {"files": 8, "extracted": 8, "cache_hits": 0}
    warm, counts = cache.refresh(spark, str(root), store)
    assert counts["cache_hits"] == 8 and sorted(map(str, warm.collect())) == cold
    (root / "empty.txt").write_text("now it has text")
    (root / "w.docx").unlink()
    docs, counts = cache.refresh(spark, str(root), store)
    assert counts == {"files": 7, "extracted": 1, "cache_hits": 6} and docs.where("text = 'now it has text'").count() == 1
    assert cache.load(spark, str(tmp_path / "none")).count() == 0


def test_stream_of_documents(spark, tmp_path):
    src = tmp_path / "src"
    docs_of(spark, ["first text here", "second text"]).drop("doc_id").write.parquet(str(src))
    stream = spark.readStream.schema("path string, title string, type string, text string").parquet(str(src))
    query = incremental.append(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    docs_of(spark, ["first text again"]).drop("doc_id").write.mode("append").parquet(str(src))
    query.processAllAvailable()
    query.stop()
    ix = incremental.load(spark, str(tmp_path / "out"))
    assert ix.documents.count() == 2 and ix.postings.where("term = 'again'").count() == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda threads=0: spark)
    (tmp_path / "at").mkdir()
    monkeypatch.chdir(tmp_path / "at")
    write_folder(tmp_path)
    ix = str(tmp_path / "ix")
    assert cli.main(["build", str(tmp_path), "-o", ix]) == 0 and cli.main(["search", ix, "договор", "--answer", "--no-color"]) == 0
    assert "a.txt#fragment-1" in capsys.readouterr().out
    assert cli.main(["search", ix, " "]) == 1 and cli.main(["nothing"]) == 1 and cli.main(["search", str(tmp_path / "none"), "x"]) == 2
    o = cli.parse(["-n", "x", "foo", "--limit", "3", "bar", "--answer", "-j", "2", "--no-color"])
    assert (o.limit, o.threads, o.answer, o.colour, o.query) == (3, 2, True, False, "foo bar") and cli.parse(["-n", "0"]).limit == 1
