"""An extension: documents that arrive as a stream are kept as a growing set of index parts.

Each micro-batch is broken into fragments and postings and written under its own number, so a
batch that is run again after a failure overwrites what it wrote. load() reads all parts
together; statistics and segments, which depend on all documents, are made then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lantern.operators.fragments import fragment_parts, part_terms
from lantern.operators.index import Index, build

COLUMNS = ("path", "title", "type", "text")


def append(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that files every micro-batch of docs (path, title, type, text) under folder."""

    def file(batch: DataFrame, number: int) -> None:
        batch.select(*COLUMNS).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(file).option("checkpointLocation", checkpoint).start()


def load(spark: SparkSession, folder: str) -> Index:
    """The index of all that has arrived; of a path that came again the last counts."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy("path").agg(F.max_by(F.struct("title", "type", "text"), "batch").alias("x"))
    return build(last.select("path", "x.title", "x.type", "x.text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, tf over a stream of documents, as a running aggregate."""
    numbered = docs.select(F.xxhash64("path").alias("doc_id"), *COLUMNS)
    return part_terms(fragment_parts(numbered)).groupBy("term").agg(F.count("*").alias("tf"))
