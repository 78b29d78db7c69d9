"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs:

1. language ID drops null texts, texts without a letter and texts that no mixture of the learned
   languages explains;
2. line dedup removes the lines that stand on five sites or more, but for their first place;
3. SimHash near-dedup on five-word shingles leaves one document of each group of fingerprints within
   three bits or of texts with a Jaccard similarity of 0.8 or more;
4. suffix-array dedup removes the later occurrences of strings of 100 bytes;
5. best-fit packing puts what is left into sequences of 2048 tokens.

All but the last return the columns of documents. An empty table passes through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lantern.llm import langid, lines, packing, simhash, suffixes
from lantern.llm.common import remove_folder, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: Jaccard similarity of shingle sets from which two texts are near copies.
SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.reject(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.remove_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, SHINGLE, SIMILARITY)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Training, fingerprints and the tokenizer have no SQL form; the stages are tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what is written between them goes to the shared
    folder that spark.checkpoint.dir names, and a stage's input goes once its output is there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    old = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if old:
            remove_folder(spark, old)
        old = out
    return docs
