"""What the corpus operators share: table access, checkpoints, column hygiene."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps
from typing import TypeVar

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte values that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of our own on a single
    machine; on a cluster, whose machines would not see each other's, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint of df in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Stands for a null id inside Python code, where a null would turn the column into
#: floating point; it sorts before every id.
NO_ID = -(2**63)


def sealed(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def unsealed(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


Batch = TypeVar("Batch")
Result = TypeVar("Result")


def give_back() -> None:
    """Hands the memory that allocators would keep for later to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[Batch]], Iterator[Result]]) -> Callable[[Iterator[Batch]], Iterator[Result]]:
    """run, giving memory back after each batch and at the end of a task: a worker stands beside
    others and a JVM, and then waits for its next task."""

    def fed(batches: Iterator[Batch]) -> Iterator[Batch]:
        for b in batches:
            yield b
            del b
            give_back()

    @wraps(run)
    def wrapped(batches: Iterator[Batch]) -> Iterator[Result]:
        yield from run(fed(batches))
        gc.collect()
        give_back()

    return wrapped
