"""Views of the driver's tables as what the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: doc_id, path, title, type, text."""
    d = read(spark, sf_dir, "documents")
    title = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", F.concat(F.lit("/corpus/"), "source", F.lit("/"), title).alias("path"), title.alias("title"), F.lit(".txt").alias("type"), "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as a batch of queries: qid, text."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a task list."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("difficulty"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("urgency"),
        (F.col("o_custkey") % 90 + 1).cast("int").alias("duration_minutes"), (F.col("o_orderstatus") == "F").alias("completed"),
        F.lit("").alias("created_at"), F.col("o_orderkey").alias("pos"),
    )
