from __future__ import annotations

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lantern.functions import fixed
from lantern.operators import fragments, index, search
from lantern.plans.physical import stored
from lantern.plans.queries import ORACLES, QUERIES
from tests.test_index_search import docs_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with stretches of over 1400 bytes without an end of a sentence, in letters of one and two bytes."""
    out = str(tmp_path_factory.mktemp("tables"))
    texts = [
        "Über den Fluß gehen " * 200, "Kurzer Satz. " + "größe" * 700 + ". Noch einer.", "plain words " * 300, "слово за словом " * 250 + "\n\nконец",
        "", None, "a.\n\x85", "one\n \t\ntwo " * 3,
    ]
    rows = [(k, t, "web") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["corpus_stats", "doc_stats", "fragment_pack", "segment_assign", "anchor_labels", "fragment_postings", "term_idf"])
def test_long_stretches_agree_with_the_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = sorted(map(tuple, QUERIES[name](spark, folder).select(*columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("by_characters", [False, True])
def test_texts_are_cut_as_columns_cut_them(spark, by_characters):
    r = random.Random(5)
    texts = ["".join(r.choice(["ab", "é", ".", "!", ";", "\n", "\n\n", "\r\n", " ", "я", "x" * 90, "\x0b", "\t"]) for _ in range(r.randint(0, 900))) for _ in range(40)]
    texts += ["", "\n", "x" * 1400, "x" * 1401, "é" * (700 if by_characters else 1500), "a\n  "]
    got = docs_of(spark, texts).select("doc_id", fragments.content_fragments(F.col("text")).alias("f")).collect()
    cut = {r["doc_id"]: fragments.py_content_fragments(texts[r["doc_id"]], by_characters) for r in got}
    assert all(r["f"] == cut[r["doc_id"]] for r in got)


def test_characters_limit():
    assert [len(x) for x in fragments.py_content_fragments("é" * 1500, True)] == [fixed.FRAGMENT_BYTES, 100]
    assert [len(x) for x in fragments.py_content_fragments("é" * 1500)] == [700, 700, 100]


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_an_index_takes_little_disk(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghik") for _ in range(7)) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(900)) for _ in range(150)]
    docs, queries = docs_of(spark, texts), spark.createDataFrame([(1, texts[0][:60])], "qid long, text string")
    root = spark.conf.get("spark.checkpoint.dir")
    before = _bytes(root)
    found = search.search(index.build(docs, numbered=True), queries, fuzzy=False).collect()
    assert len(found) == 8 and _bytes(root) - before < 2 * sum(map(len, texts))


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_the_shuffle_of_texts_goes_once_they_are_stored(spark):
    docs = docs_of(spark, [f"some words {k}. " * 50 for k in range(40)])
    spark._jvm.System.gc()
    time.sleep(2)
    before = _shuffled(spark)
    rows = stored(docs.repartition(3, "doc_id"))
    time.sleep(1)
    stored(spark.range(1))  # what the first one left goes with the next at the latest
    end = time.monotonic() + 3
    while (left := _shuffled(spark) - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left and rows.count() == 40


def test_an_empty_table_has_an_empty_index(spark):
    ix = index.build(docs_of(spark, []), numbered=True)
    assert ix.counts() == {"documents": 0, "fragments": 0, "segments": 0} and ix.corpus_stats.first()["avg_doc_len"] == 1.0
