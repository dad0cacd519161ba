"""Timing of steps of a run, and reports over a log of them; and printing of long texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.norm import text
from .numbering import with_row_number

LOG = "session_id string, process string, instance_id long, task_start timestamp_ntz, instance_start timestamp_ntz, instance_end timestamp_ntz, batch_id string, plan_id string"


def duration_text(milliseconds: int) -> str:
    """HH:MM:SS.mmm."""
    seconds, ms = divmod(milliseconds, 1000)
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{ms:03d}"


class Timer:
    """A log of instances (spans between calls) of one task after another.  A batch is known by a hash of its text, a plan by a hash of the
    query's analysed plan in its canonical form, so that texts that differ in spelling alone are batches of one plan."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple] = []
        self.begin("")

    def begin(self, batch: str, query: DataFrame | None = None) -> None:
        """Starts a task that runs the given text; ``query`` is what it reads, if it is a query.  Without one the plan is known by the text."""
        self.task_start = datetime.now()
        self.batch = hashlib.sha256(batch.encode()).hexdigest()[:16]
        self.plan = self.batch if query is None else f"{query.semanticHash() & 0xFFFFFFFF:08x}"

    def __call__(self, process: str | None = None, start: datetime | None = None, record: bool = True) -> str:
        """Ends an instance; returns what to print of it."""
        now, number = datetime.now(), len(self.rows) + 1
        last = self.rows[-1] if self.rows else None
        start = start or (last[5] if last and last[3] == self.task_start else self.task_start)
        if record:
            self.rows.append((self.spark.sparkContext.applicationId, process, number, self.task_start, start, now, self.batch, self.plan))
        took = int((now - start).total_seconds() * 1000)
        return f"{process or ''} (Instance {number if record else ''}) - {duration_text(took)}".lstrip()

    def display(self) -> DataFrame:
        """The report, or one row that says that there is nothing."""
        if not self.rows:
            return self.spark.createDataFrame([("No timer data has been recorded.",)], "Error string")
        return report(self.spark.createDataFrame(self.rows, LOG))


def report(log: DataFrame) -> DataFrame:
    """Durations in ms of instances and tasks, with least, mean (cut to a whole number) and greatest by plan, batch and process."""
    ms = lambda a, b: F.timestamp_diff("MILLISECOND", F.col(a), F.col(b))
    # numbers within a task are those of all rows in order of the tasks, less that of the task's first: a task may be of any size
    key = [F.col(c).asc() for c in ("session_id", "task_start", "instance_start", "instance_id")]
    numbered = with_row_number(log.withColumn("process", F.coalesce("process", F.lit(""))), "__n", key)
    tasks = numbered.groupBy(F.col("session_id").alias("__session"), F.col("task_start").alias("__start")).agg(F.min("__n").alias("__first"), F.max("instance_end").alias("task_end"))
    timed = numbered.join(tasks, numbered["session_id"].eqNullSafe(tasks["__session"]) & numbered["task_start"].eqNullSafe(tasks["__start"])).select(
        "session_id", "plan_id", "batch_id", "process", (F.col("__n") - F.col("__first") + 1).alias("process_instance"), "instance_id", "task_start", "task_end", "instance_start", "instance_end",
    )
    timed = timed.withColumn("task_duration", ms("task_start", "task_end")).withColumn("instance_duration", ms("instance_start", "instance_end"))
    # groups are few and rows many: sums by partial aggregation, joined back, instead of one task for each group
    for by, of in (("plan", "task_duration"), ("batch", "task_duration"), ("process", "instance_duration")):
        key = by if by == "process" else f"{by}_id"
        facts = timed.groupBy("session_id", key).agg(F.min(of).alias(f"{by}_min"), (F.sum(of) / F.count(of)).cast("long").alias(f"{by}_avg"), F.max(of).alias(f"{by}_max"))
        facts = facts.withColumnsRenamed({"session_id": "__session", key: "__key"})  # nulls are groups of their own
        timed = timed.join(facts, timed["session_id"].eqNullSafe(facts["__session"]) & timed[key].eqNullSafe(facts["__key"])).drop("__session", "__key")
    return timed


def print_parts(string: str, most: int = 4000) -> Iterator[str]:
    """A long text in parts of at most ``most`` characters, cut at the last line end where there is one."""
    string = string.replace("\r", "\n")
    while string.rstrip(" "):
        part = string[:most]
        at = part.rfind("\n")
        if at < 0:
            yield part
            string = string[len(part) :]
        else:
            yield part[:at]
            string = string[at + 1 :]


def printed_parts(string: Column | str, most: int = 4000) -> Column:
    """The parts of each text, in order; null for null.

    A part is what stands before the last line end among the next ``most`` characters, or all of them if there is none; blanks at the end are no part."""
    parts = F.regexp_extract_all(F.replace(text(string), F.lit("\r"), F.lit("\n")), F.lit(f"(?! *\\z)(?:[\\s\\S]{{0,{most - 1}}}\n|[\\s\\S]{{1,{most}}})"), F.lit(0))
    return F.transform(parts, lambda part: F.regexp_replace(part, "\n\\z", F.lit("")))
