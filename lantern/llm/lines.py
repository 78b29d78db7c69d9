"""Line dedup by distinct-site spread, in DataFrame functions only.

A line that stands on MIN_SITES sites or more (source is the site) is boilerplate: its first
occurrence, by doc_id and line number, stays and all others go. Lines are known by 128 bits
of hash. One HyperLogLog sketch of sites per line is built before the shuffle and merged
behind it, so that a line travels as one sketch per task, on however many sites it stands; no
table of lines and sites is made. A line whose estimate is under MIN_SITES by more than
BAND stays, and one whose estimate is over MIN_SITES by more than BAND is boilerplate. Lines
within BAND, and these alone, are counted exactly, from their occurrences. A hot line is combined before each grouped shuffle,
and the joins on the line are left to adaptive skew handling.

Cases: lines without a word are never boilerplate and stay. Lines are compared without the
white space around them. A null text stays null and has no lines; an empty text has one
empty line. A very long text or line is taken whole. A null source is a site of its own. Rows
that agree in doc_id and text are one document. A null doc_id comes first; of a line's
occurrences with one doc_id and line number, the first by a hash of the text. Extra columns
are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import SPACES, own_names, sealed

MIN_SITES = 5
LG_REGISTERS = 12
BAND = 0.25


def _lines(df: DataFrame) -> DataFrame:
    """doc, th, pos, h1, h2, site of every line with a word."""
    text = F.col("text").cast("string")
    rows = df.select(
        sealed("doc_id").alias("doc"), F.xxhash64(text).alias("th"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    ).withColumn("line", F.trim(F.col("line"), F.lit(SPACES)))
    return rows.where("line <> ''").select("doc", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site")


def sketches(lines: DataFrame) -> DataFrame:
    """h1, h2, first (place), sites (estimated) of every line."""
    site = F.xxhash64("site")  # a sketch passes over an empty string
    return lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(site, F.lit(LG_REGISTERS))).alias("sites"), F.min(F.struct("doc", "th", "pos")).alias("first")
    )


def boilerplate(df: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(doc, th, pos) of every line to remove."""
    lines = _lines(df)
    wide = sketches(lines).where(F.col("sites") >= min_sites * (1 - band))
    near = wide.where(F.col("sites") <= min_sites * (1 + band))
    counted = lines.join(near.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("site").alias("n"))
    enough = counted.where(F.col("n") >= min_sites).select("h1", "h2")
    # The sketches' exchange is read again for each branch, not made again.
    chosen = wide.where(F.col("sites") > min_sites * (1 + band)).unionByName(near.join(enough, ["h1", "h2"], "left_semi")).select("h1", "h2", "first")
    # Nothing above this join needs a line's rows together, so a hot line's can be split.
    return lines.join(chosen, ["h1", "h2"]).where(F.struct("doc", "th", "pos") != F.col("first")).select("doc", "th", "pos")


def marked(df: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> tuple[DataFrame, str]:
    """df and a column with the numbers of the lines to remove (null: none)."""
    doc, th, places = own_names(df, "_doc", "_th", "_places")
    gone = boilerplate(df, min_sites, band).groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    gone = gone.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("pos").alias(places))
    keyed = df.withColumn(doc, sealed("doc_id")).withColumn(th, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(gone, [doc, th], "left").drop(doc, th), places


def remove_lines(df: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """df's own columns, text without its boilerplate lines and n_chars, if there, to match."""
    d, places = marked(df, min_sites, band)
    lines, text = own_names(d, "_lines", "_text")
    d = d.withColumn(lines, F.when(F.col(places).isNotNull(), F.split(F.col("text").cast("string"), "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    new = F.when(F.col(lines).isNull(), F.col("text").cast("string")).otherwise(F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n"))
    d = d.withColumn(text, new)
    own = {"text": F.col(text), "n_chars": F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(F.length(text)) if "n_chars" in df.columns else None}
    return d.select(*(own[c].alias(c) if own.get(c) is not None else F.col(f"`{c}`") for c in df.columns))


def report(df: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_md5 of every row."""
    d, places = marked(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), min_sites, band)
    d = d.select("doc_id", "text", places, F.split("text", "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col(places))
    kept = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    return d.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_removed"), F.md5(F.coalesce(kept, F.lit("")).cast("binary")).alias("kept_md5"),
    )
