"""Order-dependent numbering without a single-task window: ranges are numbered locally, and only
one count per range meets on the driver."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shared(df: DataFrame) -> None:
    """Sees to it that a checkpoint folder is set: spark.checkpoint.dir. Where that is unset, a folder of our own on a
    single machine; on a cluster, whose machines would not see each other's, an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))


def _free_shuffles(df: DataFrame) -> None:
    """Spark removes the files of a shuffle that nothing refers to once the driver collects garbage, which by itself may
    be after the end of the query; until then they stand beside what was made of them."""
    df.sparkSession._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the checkpoint folder."""
    _shared(df)
    out = df.checkpoint(eager=True)
    _free_shuffles(df)
    return out


def stored(df: DataFrame) -> DataFrame:
    """df by way of Parquet in the checkpoint folder, for wide rows: a checkpoint is not compressed and is always read
    whole. The files go when the driver ends."""
    _shared(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    _free_shuffles(df)
    return spark.read.schema(df.schema).parquet(path)


def ranges(df: DataFrame, *keys: str, part: str = "_part") -> DataFrame:
    """df in sorted ranges of keys, each row with its range's number; checkpointed, so that the
    ranges are the same each time they are read."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    return checkpoint(ranged.withColumn(part, F.spark_partition_id()))


def offsets(ranged: DataFrame, weight: Column, part: str = "_part") -> Column:
    """The sum of weight over all earlier ranges, as a column; one number per range is collected."""
    sums = sorted(ranged.groupBy(part).agg(F.sum(weight).cast("long").alias("n")).collect())
    cases, total = [], 0
    for p, n in sums:
        cases += [F.lit(p), F.lit(total)]
        total += n or 0
    return F.try_element_at(F.create_map(*cases), F.col(part)) if cases else F.lit(0).cast("long")


def number_rows(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df with its dense rank from 0 in the order of keys (which should be unique)."""
    ranged = ranges(df, *keys)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return ranged.withColumn(name, (local + offsets(ranged, F.lit(1))).cast("long")).drop("_part")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the cluster has slots, if its input has fewer parts; as it is otherwise."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
