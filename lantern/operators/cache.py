"""Incremental builds of a folder: texts of unchanged files are taken from a Parquet cache.

The cache is a row of generations, each one table of rel_key, size, mtime, text and error. A build
reads the last complete generation, extracts only files whose key, size or time it does not have,
and writes the next one; files that are gone drop out. A missing or broken cache counts as empty.
"""

from __future__ import annotations

import hashlib
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.fixed import CACHE_DIRECTORY
from lantern.operators.index import Index, build, cache_misses
from lantern.sources.files import extract_text, list_files, read_bytes

SCHEMA = "rel_key string, size long, mtime long, text string, error string"


def cache_dir(root: str, base: str = ".") -> str:
    """The default place of a folder's cache: by a hash of its real path."""
    return os.path.join(os.path.abspath(base), CACHE_DIRECTORY, hashlib.sha256(os.path.realpath(root).encode()).hexdigest()[:16])


def _generations(path: str) -> list[int]:
    names = os.listdir(path) if os.path.isdir(path) else []
    return sorted(int(n) for n in names if n.isdigit() and os.path.exists(os.path.join(path, n, "_SUCCESS")))


def load(spark: SparkSession, path: str) -> DataFrame:
    for n in reversed(_generations(path)):
        rows = spark.read.schema(SCHEMA).parquet(os.path.join(path, str(n)))
        try:
            rows.select(F.max(F.length("text")), F.max("mtime"), F.max("error")).collect()  # reads all of it
            return rows
        except Exception:  # noqa: BLE001  a damaged generation does not count
            continue
    return spark.createDataFrame([], SCHEMA)


def save(rows: DataFrame, path: str) -> None:
    """The next generation; older ones but the last are removed."""
    old = _generations(path)
    rows.select("rel_key", "size", "mtime", "text", "error").write.parquet(os.path.join(path, str(old[-1] + 1 if old else 0)))
    for n in old[:-1]:
        shutil.rmtree(os.path.join(path, str(n)), ignore_errors=True)


def refresh(spark: SparkSession, root: str, path: str) -> tuple[DataFrame, dict[str, int]]:
    """The folder's documents (path, title, type, text, error) and how many came from the cache."""
    files = list_files(spark, root).cache()
    known = load(spark, path)
    todo = cache_misses(files, known).cache()
    counts = {"files": files.count(), "extracted": todo.count()}
    counts["cache_hits"] = counts["files"] - counts["extracted"]
    hits = files.join(known, ["rel_key", "size", "mtime"])
    fresh = extract_text(read_bytes(todo.select(files.columns)))
    save(hits.select(*files.columns, "text", "error").unionByName(fresh.select(*files.columns, "text", "error")), path)
    docs = files.join(load(spark, path), ["rel_key", "size", "mtime"])
    return docs.select("path", "title", "type", "text", "error"), counts


def build_folder(spark: SparkSession, root: str, path: str | None = None) -> tuple[Index | None, dict[str, int]]:
    """The index of a folder, None if it holds no supported file, and the counts of refresh()."""
    docs, counts = refresh(spark, root, path or cache_dir(root))
    return (build(docs) if counts["files"] else None), counts
