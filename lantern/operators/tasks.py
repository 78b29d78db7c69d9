"""Task lists: priority, order, recommendation with reason and tip, storage."""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions import fixed

SCHEMA = "task_id int, title string, difficulty int, urgency int, duration_minutes int, completed boolean, created_at string"


def bonus(minutes: Column) -> Column:
    return F.when(minutes <= 15, 3).when(minutes <= 30, 2).when(minutes <= 60, 1).otherwise(0)


def priority() -> Column:
    return F.col("urgency") * 2 + F.col("difficulty") + bonus(F.col("duration_minutes"))


def active(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.col("completed"))


def order() -> list[Column]:
    """Open tasks first, then priority, urgency, brevity; ties keep the order of input (pos)."""
    return [F.asc("completed"), F.desc("priority"), F.desc("urgency"), F.asc("duration_minutes"), F.asc("pos")]


def ranked(tasks: DataFrame, top: int | None = None) -> DataFrame:
    """tasks (with pos) and priority and place. A top of the list is a bounded merge; the whole list
    is numbered by ranges."""
    rows = tasks.withColumn("priority", priority())
    if top is not None:
        return rows.orderBy(*order()).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order())))
    from lantern.plans.physical import number_rows

    keyed = rows.withColumn("_p", -F.col("priority")).withColumn("_u", -F.col("urgency"))
    done = number_rows(keyed, "place", "completed", "_p", "_u", "duration_minutes", "pos")
    return done.withColumn("place", (F.col("place") + 1).cast("int")).drop("_p", "_u")


def reason() -> Column:
    minutes = F.col("duration_minutes")
    parts = F.array_compact(F.array(
        F.when(F.col("urgency") >= 4, fixed.REASON_URGENT).when(F.col("urgency") >= 2, fixed.REASON_MEDIUM),
        F.when(F.col("difficulty") >= 4, fixed.REASON_HARD),
        F.when(minutes <= 30, F.concat(F.lit(fixed.REASON_SHORT), minutes.cast("string"), F.lit(fixed.REASON_SHORT_END))).when(minutes <= 60, fixed.REASON_HOUR),
    ))
    return F.when(F.size(parts) == 0, fixed.REASON_DEFAULT).otherwise(F.array_join(parts, fixed.REASON_AND))


def tip() -> Column:
    return F.when(F.col("duration_minutes") <= 20, fixed.TIP_SHORT).when(F.col("difficulty") >= 4, fixed.TIP_HARD).otherwise(fixed.TIP_DEFAULT)


def recommend(tasks: DataFrame) -> DataFrame:
    """The first open task with its reason and tip; no row if there is none."""
    best = active(tasks).withColumn("priority", priority()).orderBy(*order()).limit(1)
    return best.select("task_id", "title", "priority", reason().alias("reason"), tip().alias("tip"))


def listing(tasks: DataFrame) -> DataFrame:
    """place, line: the printed list."""
    status = F.when(F.col("completed"), fixed.STATUS_DONE).otherwise(fixed.STATUS_ACTIVE)
    line = F.format_string(
        "%d. [%d] %s | статус: %s | приоритет: %d | срочность: %d/5 | сложность: %d/5 | время: %d мин",
        "place", "task_id", "title", status, "priority", "urgency", "difficulty", "duration_minutes",
    )
    return ranked(tasks).select("place", line.alias("line"))


def next_id(tasks: DataFrame) -> DataFrame:
    return tasks.agg((F.coalesce(F.max("task_id"), F.lit(0)) + 1).alias("next_id"))


def find(tasks: DataFrame, task_id: int) -> DataFrame:
    return tasks.where(F.col("task_id") == task_id).orderBy("pos").limit(1)


def complete(tasks: DataFrame, task_id: int) -> DataFrame:
    """tasks with the first row of this id completed, if it is open."""
    first = F.min(F.when(F.col("task_id") == task_id, F.col("pos"))).over(Window.partitionBy("task_id"))
    return tasks.withColumn("completed", F.col("completed") | ((F.col("task_id") == task_id) & (F.col("pos") == first)))


class TaskFile:
    """A JSON list of tasks on disk (a small file of one user)."""

    def __init__(self, path: str):
        self.path = path

    def rows(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        try:
            with open(self.path, encoding="utf-8") as f:
                rows = json.load(f)
        except (json.JSONDecodeError, OSError):
            return []
        known = {c.split()[0] for c in SCHEMA.split(", ")}
        for r in rows:
            if unknown := set(r) - known:
                raise TypeError(f"unknown fields: {sorted(unknown)}")
        return [{"completed": False, "created_at": ""} | r for r in rows]

    def read(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return spark.createDataFrame([(*(r[n] for n in names), k) for k, r in enumerate(self.rows())], SCHEMA + ", pos long")

    def write(self, rows: list[dict]) -> None:
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False, indent=2)

    def add(self, title: str, difficulty: int, urgency: int, duration_minutes: int) -> dict:
        title = title.strip()
        if not title:
            raise ValueError("a task has a title")
        for name, value, most in (("difficulty", difficulty, 5), ("urgency", urgency, 5), ("duration_minutes", duration_minutes, None)):
            if value < 1 or most is not None and value > most:
                raise ValueError(f"{name} is out of range")
        rows = self.rows()
        new = {
            "task_id": max((r["task_id"] for r in rows), default=0) + 1, "title": title, "difficulty": difficulty, "urgency": urgency,
            "duration_minutes": duration_minutes, "completed": False, "created_at": datetime.datetime.now().isoformat(timespec="minutes"),
        }
        self.write([*rows, new])
        return new

    def complete(self, task_id: int) -> bool:
        rows = self.rows()
        row = next((r for r in rows if r["task_id"] == task_id), None)
        if row is None or row["completed"]:
            return False
        row["completed"] = True
        self.write(rows)
        return True


#: The task file beside this module's package, if no other is named.
DEFAULT_FILE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tasks.json")


def ask_text(label: str) -> str:
    """What is typed, asked again until it is not empty."""
    while not (value := input(f"{label}: ").strip()):
        print("It must not be empty.")
    return value


def ask_number(label: str, most: int | None = None) -> int:
    """A whole number from 1 (to most), asked again until it is one."""
    while True:
        text = input(f"{label}: ").strip()
        try:
            value = int(text)
        except ValueError:
            print("It must be a whole number.")
            continue
        if value >= 1 and (most is None or value <= most):
            return value
        print(f"It must be from 1 to {most}." if most else "It must be 1 or more.")


def menu(spark: SparkSession, path: str) -> None:
    """Five numbered actions over a task file, until the last is chosen or the input ends."""
    store = TaskFile(path)

    def add() -> None:
        new = store.add(ask_text("Title"), ask_number("Difficulty (1-5)", 5), ask_number("Urgency (1-5)", 5), ask_number("Minutes"))
        row = find(store.read(spark), new["task_id"]).select(priority().alias("priority"), reason().alias("reason")).first()
        print(f"Added [{new['task_id']}], priority {row['priority']}: {row['reason']}.")

    def show() -> None:
        lines = [r["line"] for r in listing(store.read(spark)).orderBy("place").collect()]
        print("\n".join(lines) or "There are no tasks yet.")

    def advise() -> None:
        best = recommend(store.read(spark)).first()
        print(f"{best['title']}\n{best['reason']}.\n{best['tip']}" if best else "There is no open task.")

    def finish() -> None:
        rows = ranked(active(store.read(spark))).orderBy("place").collect()
        if not rows:
            print("There is no open task.")
            return
        print("\n".join(f"[{r['task_id']}] {r['title']}" for r in rows))
        print("Done." if store.complete(ask_number("Id")) else "No open task has this id.")

    actions = [("Add a task", add), ("Show all tasks", show), ("Advise", advise), ("Complete a task", finish), ("Leave", None)]
    try:
        while True:
            print("\n".join(["", *(f"{k}. {label}" for k, (label, _) in enumerate(actions, 1))]))
            choice = input("Number: ").strip()
            if choice not in [str(k) for k in range(1, len(actions) + 1)]:
                print(f"It must be a number from 1 to {len(actions)}.")
                continue
            act = actions[int(choice) - 1][1]
            if act is None:
                return
            act()
    except EOFError:
        return
