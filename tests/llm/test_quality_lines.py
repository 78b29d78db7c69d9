from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from lantern.llm import lines, quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text = text or ""
    w = words(text)
    win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(win)
    covered = {j for k, x in enumerate(win) if n[x] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_against_plain_code(spark, small, edge_docs):
    made = [(1000, "a b c a b c"), (1001, "x x x x x"), (1002, "p\nq\np\n\n \np\n"), (1003, "a b c d a b c d e a b"), (1004, "a b")]
    for df in (small.select("doc_id", "text"), spark.createDataFrame(made, "doc_id long, text string"), edge_docs.where("doc_id is not null").select("doc_id", "text").distinct()):
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in quality.judge(df, []).collect():
            assert tuple(r)[1:6] == base(text[r["doc_id"]]), text[r["doc_id"]][:80]
            failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_the_whole_query_against_plain_code(spark, small):
    """Features, list and verdict of every row, without columns."""
    from lantern.llm import queries

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rules = quality.fit(small, labels)

    def features(text):
        n, chars, symbols, dup, repeats = base(text)
        full = sum(bool(words(x)) for x in (text or "").split("\n"))
        count = lambda p: len(re.findall(p, text or ""))
        return {
            "words": float(n), "word_length": chars / max(n, 1), "symbols": symbols / max(chars, 1), "duplicate_lines": dup / max(full, 1),
            "repeats": repeats / max(n, 1), "capitals": count("[A-Z]") / max(chars, 1), "exclamations": count("!") / max(chars, 1),
            "digits": count("[0-9]") / max(chars, 1), "words_per_line": n / max(full, 1),
        }

    want = {}
    for r in small.collect():
        n, *_, repeats = base(r["text"])
        failed = n < 50 or 100 * repeats > 50 * n
        x = features(r["text"])
        rejected = any(all((x[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
        want[r["doc_id"]] = (*base(r["text"]), failed, not failed and not rejected)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in queries.op6_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(not x[-1] and not x[-2] for x in want.values()) == bool(rules)


def test_ties_between_thresholds():
    """Two features that part the rows alike: the one that is named first is taken."""
    names = [*quality.FEATURES]
    rows = [({f: float(k if f in names[2:4] else 0) for f in names}, k >= 30) for k in range(60)]
    assert quality._grow_one(rows) == quality.Condition(names[2], True, 29.5)
    assert quality.learn(rows) == quality.learn(list(rows))


def test_learning_finds_planted_conjunctions():
    import random

    r = random.Random(2)
    rows = []
    for _ in range(900):
        x = {f: r.random() for f in quality.FEATURES}
        rows.append((x, x["symbols"] > 0.7 and x["digits"] < 0.4 or x["capitals"] > 0.9))
    rules = quality.learn(rows)
    judged = [(any(all(c.holds(x) for c in rule) for rule in rules), y) for x, y in rows]
    assert sum(a == b for a, b in judged) > 0.95 * len(judged) and all(len(rule) <= quality.CONDITIONS_MAX for rule in rules)
    assert quality.learn([]) == [] and quality.learn([(x, False) for x, _ in rows]) == []
    noise = [(x, r.random() < 0.3) for x, _ in rows]
    assert sum(any(all(c.holds(x) for c in rule) for rule in quality.learn(noise)) for x, _ in noise) < 90


def test_list_is_an_ordered_expression(spark):
    df = spark.createDataFrame([(1, "word " * 60), (2, " ".join(f"##{k}" for k in range(60))), (3, " ".join(f"w{k}" for k in range(60)))], "doc_id long, text string")
    rules = [(quality.Condition("symbols", True, 0.3),)]
    assert {r["doc_id"]: r["kept"] for r in quality.judge(df, rules).collect()} == {1: False, 2: False, 3: True}


def test_quality_edges(spark, edge_docs, no_docs, small):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (1, None, 0), (24, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge_documents(edge_docs, labels).count() == edge_docs.count()
    assert quality.judge_documents(no_docs, labels).count() == 0 and quality.fit(edge_docs, labels.limit(0)) == []
    found = quality.judge_documents(small, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert not any("Python" in x or "Arrow" in x for x in found._jdf.queryExecution().executedPlan().toString().split())


def plain_lines(rows, min_sites):
    sites, first = {}, {}
    for d, t, s in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            x = line.strip(" \t\n\x0b\f\r")
            if x:
                sites.setdefault(x, set()).add(s or "")
                at = (d if d is not None else -(2**63), k)
                first[x] = min(first.get(x, at), at)
    out = {}
    for d, t, _ in rows:
        kept = []
        for k, line in enumerate(t.split("\n")) if t is not None else []:
            x = line.strip(" \t\n\x0b\f\r")
            if not x or len(sites[x]) < min_sites or first[x] == (d if d is not None else -(2**63), k):
                kept.append(line)
        out[d] = "\n".join(kept) if t is not None else None
    return out


@pytest.mark.parametrize("band", [0.25, 0.9])
def test_lines_against_plain_code(spark, band):
    import random

    r = random.Random(4)
    pool = [f"line {k}" for k in range(30)] + ["", " ", "\ttabbed ", "tabbed"]
    rows = [(k, r.choice([None, ""] + ["\n".join(r.choice(pool) for _ in range(r.randint(1, 12)))] * 9), r.choice(["a", "b", "c", "d", "e", "f", None])) for k in range(80)]
    rows += [(None, "line 1\nline 2", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain_lines(rows, 5)
    got = {x["doc_id"]: x["text"] for x in lines.remove_lines(df, 5, band).collect()}
    assert got == want
    for x in lines.report(df, 5, band).collect():
        assert x["kept_md5"] == hashlib.md5((want[x["doc_id"]] or "").encode()).hexdigest()


def test_exact_counts_are_for_near_lines_alone(spark):
    """Lines on 1, 4, 5, 6 and 30 sites: the plan holds no table of lines and sites but that of near lines."""
    rows = [(100 * n + k, f"on {n}\nown {n} {k}", f"s{k}") for n in (1, 4, 5, 6, 30) for k in range(n)] + [(9000 + k, "on 4", f"s{k % 4}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sites = {r["sites"] for r in lines.sketches(lines._lines(df)).collect()}
    assert sites == {1, 4, 5, 6, 30}
    gone = lines.boilerplate(df)
    assert sorted(r["doc"] for r in gone.collect()) == sorted(100 * n + k for n in (5, 6, 30) for k in range(1, n))
    logical = lines.sketches(lines._lines(df))._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Aggregate") == 1 and "hll_sketch_agg" in logical


def test_lines_of_long_texts(spark):
    """Texts over a megabyte, one of them a single line."""
    long = "word " * 300_000
    rows = [(k, f"same\n{long}{k % 2}\nend {k}", f"s{k}") for k in range(6)] + [(9, long, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in lines.remove_lines(df, 3).collect()} == plain_lines(rows, 3)


def test_lines_edges(edge_docs, no_docs):
    out = lines.remove_lines(edge_docs)
    assert out.columns == edge_docs.columns and out.dtypes == edge_docs.dtypes and out.count() == edge_docs.count()
    assert out.where("text is null").count() == 2 and lines.remove_lines(no_docs).count() == 0 and lines.report(no_docs).count() == 0
    spread = edge_docs.sparkSession.createDataFrame([(k, "same\nown %d" % k, "en", f"s{k}", 10, 0.1, "", "", 1, None) for k in range(6)], edge_docs.schema)
    left = lines.remove_lines(spread).orderBy("doc_id").collect()
    assert [r["text"] for r in left] == ["same\nown 0"] + [f"own {k}" for k in range(1, 6)] and [r["n_chars"] for r in left][1:] == [5] * 5
