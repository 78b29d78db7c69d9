from __future__ import annotations

import corpus_pipeline


def through(spark, docs, tmp_path):
    """The rows after each stage, each written and read again."""
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def test_stages_on_the_small_table(spark, small, tmp_path):
    from tests.llm.test_quality_lines import plain_lines
    from tests.llm.test_similar import jaccard, shingles
    from tests.llm.test_simhash import classes, plain_fingerprint
    from tests.llm.test_suffixes import plain_removal

    start, known, lined, single, cut, packed = through(spark, small, tmp_path)
    for df in (known, lined, single, cut):
        assert df.columns == small.columns
    assert known.count() == start.count()  # every text is in a known language
    want = plain_lines([(r["doc_id"], r["text"], r["source"]) for r in known.collect()], 5)
    texts = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert texts == want
    fps = {k: plain_fingerprint(t, 5) for k, t in texts.items()}
    keys = sorted(fps)
    sets = {k: shingles(t or "") for k, t in texts.items()}
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 or sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8
    groups = classes([(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if near(a, b)], keys)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))
    left = plain_removal([(r["doc_id"], r["text"]) for r in single.collect()], 100)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {d: x.decode("utf-8", "ignore") for d, (x, _) in left.items()}
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in cut.collect()}


def test_stages_on_edge_rows(spark, edge_docs, no_docs, tmp_path):
    rows = through(spark, edge_docs, tmp_path)
    assert all(df.columns == edge_docs.columns for df in rows[:-1]) and rows[-1].count() > 0
    (tmp_path / "none").mkdir()
    assert [df.count() for df in through(spark, no_docs, tmp_path / "none")] == [0] * 6


def test_run(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_queries_are_registered():
    import __spark_entry__

    names = [*__spark_entry__.queries()]
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
