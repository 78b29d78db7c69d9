"""Two-stage BM25 search of a batch of queries over an index, in one plan keyed by qid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import fixed
from lantern.functions.terms import fold, trim
from lantern.operators.expand import base_terms, expand
from lantern.operators.index import Index, idf
from lantern.plans.physical import checkpoint, stored

#: A batch of expanded query terms under this many rows is broadcast to the postings; others shuffle.
BROADCAST_TERMS = 200_000


def _small(df: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_TERMS else df


def bm25(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (fixed.K1 + 1.0) / (tf + fixed.K1 * (1.0 - fixed.B + fixed.B * length / mean))


def folded_queries(queries: DataFrame) -> DataFrame:
    return queries.select("qid", trim(fold("text")).alias("folded"))


def known_terms(index: Index, expanded: DataFrame, base: DataFrame | None, rows: int | None) -> DataFrame:
    """The expanded terms that the index knows, with doc_df, fragment_df and whether they are the query's own (own)."""
    if "own" in expanded.columns:
        return expanded
    own = expanded.withColumn("own", F.lit(0))
    if base is not None:
        own = expanded.join(_small(base.select("qid", "term", F.lit(1).alias("own")), rows), ["qid", "term"], "left").fillna(0, ["own"])
    # Spark moves this semi-join below the aggregate of an index that is not saved: no other term is counted.
    counted = index.terms.join(_small(expanded.select("term").distinct(), rows), "term", "left_semi")
    return counted.join(_small(own, rows), "term")


def _asked(index: Index, expanded: DataFrame, base: DataFrame | None, df: str, rows: int | None) -> DataFrame:
    known = known_terms(index, expanded, base, rows)
    return _small(known.select("qid", "term", "weight", "own", F.col(df).alias("df")), rows)


def score_docs(index: Index, expanded: DataFrame, rows: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score: the sum over expanded terms of weight, rarity and saturated frequency; n_found: how
    many of base stand in the document."""
    stats = F.broadcast(index.corpus_stats)  # one row
    scored = index.doc_postings.join(_asked(index, expanded, base, "doc_df", rows), "term").crossJoin(stats)
    # Later joins would infer this for one of their sides alone, and Spark would score twice instead of sharing.
    scored = scored.where("qid IS NOT NULL AND doc_id IS NOT NULL")
    part = F.col("weight") * idf(F.col("n_docs"), F.col("df")) * bm25(F.col("tf"), F.col("length"), F.col("avg_doc_len"))
    return scored.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"), F.sum("own").alias("n_found"))


def _coverage(base: DataFrame, rows: int | None) -> DataFrame:
    return _small(base.groupBy("qid").agg(F.count("*").alias("n_base")), rows)


def _named(index: Index, queries: DataFrame, rows: int | None) -> DataFrame:
    """qid, doc_id, in_title, in_path: the documents whose title or path holds a whole query. They are few, so that the
    scores of all documents need not meet the titles."""
    d = index.documents.select("doc_id", fold("title").alias("title"), fold("path").alias("path"))
    asked = _small(folded_queries(queries).where(F.octet_length("folded") >= 4), rows)
    title, path = F.contains("title", "folded"), F.contains("path", "folded")
    return d.join(asked, title | path).select("qid", "doc_id", title.alias("in_title"), path.alias("in_path"))


def boost_docs(index: Index, scores: DataFrame, base: DataFrame, queries: DataFrame, rows: int | None = None) -> DataFrame:
    """scores (of score_docs() with base) with coverage, title and path taken into account."""
    d = scores.join(_coverage(base, rows), "qid").join(_named(index, queries, rows), ["qid", "doc_id"], "left")
    score = F.col("score") * (0.88 + 0.34 * (F.col("n_found") / F.col("n_base")))
    score = score + F.when(F.col("in_title"), 2.25).otherwise(0.0) + F.when(F.col("in_path"), 1.0).otherwise(0.0)
    return d.select("qid", "doc_id", score.alias("score"))


def ranked(scores: DataFrame, key: str) -> DataFrame:
    """Positive scores with their place in the query; scores equal to nine digits tie and go by key."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), key)
    return scores.where("score > 0").withColumn("place", F.row_number().over(order))


def doc_limit(limit: int) -> int:
    return max(8 * limit, 24)


def segment_limit(limit: int) -> int:
    return max(limit // 2 + 1, 3)


def segment_top(index: Index, docs: DataFrame, limit: int) -> DataFrame:
    """qid, segment_id, score, place of the best segments by their share of the best of docs (boosted scores).

    The best documents are kept in each task before they meet, here and in candidates()."""
    top = ranked(docs, "doc_id").where(F.col("place") <= doc_limit(limit)).join(index.documents.select("doc_id", "segment_id"), "doc_id")
    return ranked(top.groupBy("qid", "segment_id").agg(F.sum("score").alias("score")), "segment_id").where(F.col("place") <= segment_limit(limit))


def candidates(index: Index, docs: DataFrame, limit: int, asked: int | None = None) -> DataFrame:
    """qid, doc_id, doc_score: the best documents of the best segments; asked: how many queries there are.

    Not checkpointed on the way: the scores of all documents are shuffled once and read by both steps."""
    n = None if asked is None else asked * segment_limit(limit)
    allowed = _small(segment_top(index, docs, limit).select("qid", "segment_id"), n)
    members = index.documents.select("doc_id", "segment_id").join(allowed, "segment_id").select("qid", "doc_id")
    inside = docs.join(_small(members, None if n is None else n * fixed.SEGMENT_DOCS), ["qid", "doc_id"])
    return ranked(inside, "doc_id").where(F.col("place") <= doc_limit(limit)).select("qid", "doc_id", F.col("score").alias("doc_score"))


def score_fragments(index: Index, expanded: DataFrame, chosen: DataFrame, rows: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """qid, fragment_id, doc_id, doc_score, score, n_found; rarity counts all fragments, not the candidates'."""
    chosen = checkpoint(chosen)  # few documents of each query: their postings alone are unfolded and travel
    n = chosen.count()
    posts = _of_documents(index.postings, chosen, n).join(_asked(index, expanded, base, "fragment_df", rows), "term")
    hits = posts.join(_small(chosen, n), ["qid", "doc_id"]).join(index.fragments.select("fragment_id", "length"), "fragment_id")
    part = F.col("weight") * idf(F.col("n_fragments"), F.col("df")) * bm25(F.col("tf"), F.col("length"), F.col("avg_fragment_len"))
    return hits.crossJoin(F.broadcast(index.corpus_stats)).groupBy("qid", "fragment_id", "doc_id", "doc_score").agg(F.sum(part).alias("score"), F.sum("own").alias("n_found"))


def _of_documents(table: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    return table.join(_small(chosen.select("doc_id").distinct(), n), "doc_id", "left_semi")


def fragments_of(index: Index, results: DataFrame, *columns: str) -> DataFrame:
    """results (fragment_id, doc_id, ...; a checkpoint) with columns of their fragments; texts do not travel where
    results are few."""
    n = results.count()
    return _of_documents(index.fragments, results, n).select("fragment_id", *columns).join(_small(results, n), "fragment_id")


def boost_fragments(index: Index, scores: DataFrame, base: DataFrame, queries: DataFrame, rows: int | None = None) -> DataFrame:
    d = fragments_of(index, checkpoint(scores), "text", "metadata_only").join(_coverage(base, rows), "qid")
    d = d.join(index.documents.select("doc_id", "title"), "doc_id").join(_small(folded_queries(queries), rows), "qid")
    meta, size = F.col("metadata_only"), F.octet_length("folded")
    score = F.col("score") * (0.85 + 0.30 * (F.col("n_found") / F.col("n_base")))
    score = score + F.col("doc_score") * F.when(meta, 0.10).otherwise(0.18)
    score = score + F.when((size >= 4) & F.contains(fold("text"), F.col("folded")), 1.25).otherwise(0.0)
    score = F.when(meta, score * 0.72 + F.when((size >= 3) & F.contains(fold("title"), F.col("folded")), 3.0).otherwise(0.0)).otherwise(score)
    return d.select("qid", "fragment_id", "doc_id", score.alias("score"))


def asked_terms(index: Index, queries: DataFrame, fuzzy: bool, count: bool = True) -> tuple[DataFrame, DataFrame, int | None, int | None]:
    """Base terms, known expanded terms, how many of these and of queries with any there are. Expanded and looked up
    once; the counts decide on broadcasting, nothing else."""
    base = base_terms(queries)
    expanded = checkpoint(expand(base, index.vocab_grams if fuzzy else None))
    # As a file, not a checkpoint: Spark sees that two scans of it are the same, and scores documents once.
    known = stored(known_terms(index, expanded, base, expanded.count() if count else None))
    n = known.agg(F.count("*"), F.count_distinct("qid")).first() if count else None
    return base, known, *(n or (None, None))


def search(index: Index, queries: DataFrame, limit: int = 8, fuzzy: bool = True, count: bool = True) -> DataFrame:
    """qid, place, fragment_id, doc_id, score: the best fragments of every query (qid, text).

    A query without terms, or that meets no document, has no rows."""
    base, expanded, rows, asked = asked_terms(index, queries, fuzzy, count)
    docs = boost_docs(index, score_docs(index, expanded, rows, base), base, queries, rows)
    chosen = candidates(index, docs, limit, asked)
    found = boost_fragments(index, score_fragments(index, expanded, chosen, rows, base), base, queries, rows)
    return ranked(found, "fragment_id").where(F.col("place") <= limit).select("qid", "place", "fragment_id", "doc_id", "score")
