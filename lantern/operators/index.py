"""Index tables as DataFrame aggregations, their persistence and incremental builds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.terms import grams
from lantern.operators.fragments import assign_segments, document_rows, fragment_tables
from lantern.plans.physical import number_rows

VERSION = 5
TABLES = ("documents", "fragments", "postings", "doc_postings", "segments", "corpus_stats", "terms", "vocab_grams")
#: Tables that indexes of the version before do not have; they are made from its postings.
NEW_TABLES = ("terms", "vocab_grams")


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def doc_postings(posts: DataFrame) -> DataFrame:
    """term, doc_id, tf, fragments: over a document's fragments, and how many hold the term."""
    return posts.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.count("*").alias("fragments"))


def term_table(doc_posts: DataFrame) -> DataFrame:
    """term, doc_df, fragment_df: in how many documents and fragments each stands."""
    return doc_posts.groupBy("term").agg(F.count("*").alias("doc_df"), F.sum("fragments").alias("fragment_df"))


def corpus_stats(documents: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row: n_docs, n_fragments, avg_doc_len, avg_fragment_len; an average of 0 counts as 1."""

    def mean(name: str) -> Column:
        return F.coalesce(F.when(F.avg(name) > 0, F.avg(name)), F.lit(1.0))

    d = documents.agg(F.count("*").alias("n_docs"), mean("length").alias("avg_doc_len"))
    f = fragments.agg(F.count("*").alias("n_fragments"), mean("length").alias("avg_fragment_len"))
    return d.crossJoin(f).select("n_docs", "n_fragments", "avg_doc_len", "avg_fragment_len")  # one row each


def segments(documents: DataFrame) -> DataFrame:
    return documents.groupBy("segment_id").agg(
        F.min("doc_id").alias("first_doc_id"), F.count("*").alias("doc_count"),
        F.min("first_fragment_id").alias("first_fragment_id"), F.sum("fragment_count").alias("fragment_count"), F.sum("length").alias("length"),
    )


def vocab_grams(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.explode(grams(F.col("term"))).alias("gram"), "term")


@dataclass
class Index:
    """The tables of an index; each is lazy until it is saved or asked."""

    documents: DataFrame
    fragments: DataFrame
    postings: DataFrame
    doc_postings: DataFrame
    segments: DataFrame
    corpus_stats: DataFrame
    terms: DataFrame
    vocab_grams: DataFrame

    def counts(self) -> dict[str, int]:
        return {n: getattr(self, n).count() for n in ("documents", "fragments", "segments")}

    def save(self, path: str) -> None:
        """One Parquet directory per table; postings and term tables sorted, so that row groups can be
        skipped. The version row is written last: without it there is no index."""
        for name in TABLES:
            df = getattr(self, name)
            if key := {"postings": "term", "doc_postings": "term", "terms": "term", "vocab_grams": "gram"}.get(name):
                df = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        self.documents.sparkSession.createDataFrame([(VERSION,)], "version int").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """An index of this version, or of the one before with its missing tables made anew."""
        version = spark.read.parquet(f"{path}/meta").first()
        if version is None or version["version"] not in (VERSION - 1, VERSION):
            raise ValueError(f"{path} is no index of version {VERSION}")
        old = version["version"] < VERSION
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES if not (old and n in NEW_TABLES)}
        if old:
            tables["doc_postings"] = doc_postings(tables["postings"])
            tables["terms"] = term_table(tables["doc_postings"])
            tables["vocab_grams"] = vocab_grams(tables["terms"])
        if "length" not in tables["doc_postings"].columns:  # as they were once saved
            tables["doc_postings"] = tables["doc_postings"].join(tables["documents"].select("doc_id", "length"), "doc_id")
        out = cls(**tables)
        stats = out.corpus_stats.first()
        if stats is None or (out.documents.count(), out.fragments.count()) != (stats["n_docs"], stats["n_fragments"]):
            raise ValueError(f"{path}: tables do not agree")
        return out


def build(docs: DataFrame, numbered: bool = False, by_characters: bool = False) -> Index:
    """An index of docs (path, title, type, text; doc_id if numbered, else by rank of path).

    by_characters: a stretch without an end of a sentence is cut after FRAGMENT_BYTES characters, not bytes."""
    if not numbered:
        docs = number_rows(docs, "doc_id", "path")
    rows = document_rows(docs, by_characters)
    frags, posts = fragment_tables(rows)
    total = rows.agg(F.coalesce(F.sum("fragment_count"), F.lit(0)).alias("total"))
    listed = rows.select("doc_id", "path", "title", "type", "length", "fragment_count", "first").crossJoin(F.broadcast(total))
    listed = listed.withColumn("first_fragment_id", F.when(F.col("fragment_count") > 0, F.col("first")).otherwise(F.col("total"))).drop("first", "total")
    documents = listed.join(assign_segments(rows.select("doc_id", "fragment_count")), "doc_id")
    by_doc = rows.select("doc_id", "length", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf", F.size("t.places").cast("long").alias("fragments"), "length")
    known = term_table(by_doc)
    return Index(documents, frags, posts, by_doc, segments(documents), corpus_stats(listed, frags), known, vocab_grams(known))


def add_documents(docs: DataFrame, more: DataFrame) -> Index:
    """An index of docs and more together, numbered anew."""
    return build(docs.unionByName(more))


def cache_misses(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (rel_key, size, mtime, ...) that the manifest does not have with the same size and time."""
    return files.join(manifest.select("rel_key", "size", "mtime"), ["rel_key", "size", "mtime"], "left_anti")


def refresh_cache(files: DataFrame, prepared: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows of prepared, files to extract): hits by key, size and time keep their text; files
    that are gone drop out."""
    hits = files.join(manifest.select("rel_key", "size", "mtime"), ["rel_key", "size", "mtime"], "left_semi")
    return prepared.join(hits.select("rel_key"), "rel_key", "left_semi"), cache_misses(files, manifest)
