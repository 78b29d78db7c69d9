"""Planner run logs: parsing, aggregation, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS_LIMIT, RUNS = 256, 10


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, line of every log file; a file is one row of its own, so lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def runs(lines: DataFrame) -> DataFrame:
    """path, test_id, run_no, moves, steps, outcome: a run belongs to the test that started last before it."""
    w = Window.partitionBy("path").orderBy("pos")
    test = F.regexp_extract("line", r"Starting Test (\d+)", 1)
    d = lines.withColumn("test_id", F.last(F.when(test != "", test.cast("int")), ignorenulls=True).over(w)).where(F.startswith("line", F.lit("#\tNew test")))
    steps = F.regexp_extract("line", r"done in (\d+) steps", 1)
    outcome = (
        F.when(steps != "", "win").when(F.contains("line", F.lit(" terminated at step ")), "x").when(F.contains("line", F.lit(" terminated!")), "q").otherwise("fail")
    )
    return d.select(
        "path", "test_id", F.row_number().over(Window.partitionBy("path", "test_id").orderBy("pos")).alias("run_no"),
        F.regexp_extract_all("line", F.lit(r"go ([UDLR])"), F.lit(1)).alias("moves"), F.when(steps != "", steps.cast("int")).otherwise(-1).alias("steps"), outcome.alias("outcome"),
    )


def summaries(lines: DataFrame) -> DataFrame:
    """path, test_id, winrate, av_steps, score as the log states them."""
    pattern = r"Test (\d+): winrate=(-?\d+)% av\.steps=(-?\d+) score=(-?\d+)"
    rows = lines.where(F.regexp_like("line", F.lit(pattern)))
    names = ("test_id", "winrate", "av_steps", "score")
    return rows.select("path", *(F.regexp_extract("line", pattern, k + 1).cast("int").alias(n) for k, n in enumerate(names)))


def aggregate(rows: DataFrame, steps_limit: int = STEPS_LIMIT, n_runs: int = RUNS) -> DataFrame:
    """test_id, wins, sum_steps, winrate, av_steps, score in whole numbers, cut towards zero."""
    won = F.when(F.col("steps") > 0, F.col("steps"))
    d = rows.groupBy("test_id").agg(F.count(won).alias("wins"), F.coalesce(F.sum(won), F.lit(0)).alias("sum_steps"))
    return d.select(
        "test_id", "wins", "sum_steps", F.expr(f"100 * wins div {n_runs}").alias("winrate"),
        F.expr("CASE WHEN wins > 0 THEN sum_steps div wins ELSE 0 END").alias("av_steps"),
        F.expr(f"(100 * (wins * {steps_limit} - sum_steps)) div {steps_limit} div {n_runs}").alias("score"),
    )


def log_lines(rows: DataFrame, steps_limit: int = STEPS_LIMIT, n_runs: int = RUNS) -> DataFrame:
    """test_id, k, line: the log of runs (test_id, run_no, moves, steps), in order of test_id and k."""
    go = F.array_join(F.transform("moves", lambda m: F.concat(F.lit("go "), m, F.lit(" "))), "")
    end = F.when(F.col("steps") > 0, F.concat(F.lit(" done in "), F.col("steps").cast("string"), F.lit(" steps!"))).otherwise(" fail!")
    own = rows.select("test_id", F.col("run_no").cast("int").alias("k"), F.concat(F.lit("#\tNew test... "), go, end).alias("line"))
    totals = aggregate(rows, steps_limit, n_runs)
    head = totals.select("test_id", F.lit(0).alias("k"), F.format_string("#####\tStarting Test %02d...", "test_id").alias("line"))
    tail = totals.select(
        "test_id", F.lit(2**31 - 1).alias("k"), F.format_string("#####\tTest %02d: winrate=%d%% av.steps=%d score=%d", "test_id", "winrate", "av_steps", "score").alias("line")
    )
    return head.unionByName(own).unionByName(tail)
