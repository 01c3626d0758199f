"""Taking files that earlier runs left behind to the store.

A pass looks at every file below ``staging`` that is due: new ones at once,
those whose upload failed one period after it, again and again.  A file that is
read through becomes an object below ``target`` in the bucket of its first
event, a broken one is moved to ``failed``, and one whose upload fails stays
where it is until it is due.

What a pass will do is stored as its plan before anything moves; then its
attempts are stored, then the files that wait.  Every step can be done again: a
pass that died is found by its plan and finished first, and moves that it had
made find themselves done.  One pass at a time may work on a ``root``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.transfer import is_committed, is_file, move_into, object_name, put_file, remove_file, subfolders
from eventweir.operators.files import RETRY_PERIOD, verify_listing
from eventweir.session import delete_folder
from eventweir.sources.listing import list_objects

TASK_BYTES = 512 * 1024 * 1024
WAITING = "file string, attempts int, due_at bigint"
ATTEMPT = (
    "file string, attempt int, outcome string, event_type string, date string, hour string, "
    "n_records bigint, duration_ms bigint, finished_at bigint, moved_to string, message string"
)
#: Plans and waiting lists that are kept.
KEEP = 2


@dataclass(frozen=True)
class Recovery:
    """Folders all tasks reach.  ``put(source, target)`` copies a file to its place
    below ``target`` or raises; repeated, it replaces what it wrote.  ``period``
    is in seconds, as is ``now`` of a pass."""

    staging: str
    target: str
    failed: str
    root: str
    period: int = RETRY_PERIOD
    put: Callable[[str, str], None] = put_file


def recover_files(spark: SparkSession, config: Recovery, now: int) -> DataFrame:
    """Run one pass, after finishing one that died; returns its attempts
    (``file, attempt, outcome, event_type, date, hour, n_records, duration_ms,
    finished_at, moved_to, message``), in the form ``upload_stats`` and
    ``retry_ledger`` read."""
    number = _last(config, "waiting") + 1
    if is_committed(_path(config, "plan", number)):
        _finish(spark, config, number)
        number += 1
    _plan(spark, config, number, now)
    _finish(spark, config, number)
    return read_attempts(spark, config, number)


def read_attempts(spark: SparkSession, config: Recovery, number: int | None = None) -> DataFrame:
    """Attempts of one pass, or of all finished ones with their ``pass``."""
    if number is not None:
        return spark.read.schema(ATTEMPT).parquet(_path(config, "attempts", number))
    # Passes follow each other, so those up to the last one are there.
    every = [_path(config, "attempts", n) for n in range(1, _last(config, "waiting") + 1)]
    if not every:
        return spark.createDataFrame([], f"{ATTEMPT}, pass int")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/attempts=(\d+)/", 1).cast("int")
    return spark.read.schema(ATTEMPT).parquet(*every).withColumn("pass", number)


def waiting_files(spark: SparkSession, config: Recovery) -> DataFrame:
    """Files whose upload failed: ``file, attempts, due_at``."""
    return _waiting(spark, config, _last(config, "waiting"))


def _waiting(spark: SparkSession, config: Recovery, number: int) -> DataFrame:
    if number == 0:
        return spark.createDataFrame([], WAITING)
    return spark.read.schema(WAITING).parquet(_path(config, "waiting", number))


def _path(config: Recovery, kind: str, number: int) -> str:
    return f"{config.root.rstrip('/')}/{kind}={number:09d}"


def _last(config: Recovery, kind: str) -> int:
    numbers = [int(name.partition("=")[2]) for name in subfolders(config.root) if name.startswith(f"{kind}=")]
    return max((n for n in numbers if is_committed(_path(config, kind, n))), default=0)


def _plan(spark: SparkSession, config: Recovery, number: int, now: int) -> None:
    """Store all staged files: those that are due with what is found in them."""
    staged = list_objects(spark, config.staging).select(F.col("location").alias("file"), "size")
    known = staged.join(_waiting(spark, config, number - 1), "file", "left")
    known = known.withColumn("is_due", F.coalesce(F.col("due_at") <= F.lit(now), F.lit(True)))
    due = verify_listing(known.where("is_due").select("file", "size"))
    ok = F.col("status") == "ok"
    due = due.select(
        "file", "status", "n_records",
        *[F.when(ok, F.col(c)).alias(name) for c, name in (("first_type", "event_type"), ("date", "date"), ("hour", "hour"))],
    )
    plan = known.join(due, "file", "left")
    plan = plan.withColumns({"attempts": F.coalesce("attempts", F.lit(0)), "now": F.lit(now).cast("bigint")})
    plan.write.mode("overwrite").parquet(_path(config, "plan", number))


def _finish(spark: SparkSession, config: Recovery, number: int) -> None:
    """Do what a stored plan says, store the attempts and who waits."""
    plan = spark.read.parquet(_path(config, "plan", number))
    # Rows are short but stand for files, so the number of tasks follows the bytes.
    due = plan.where("is_due")
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(due.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    done = due.repartition(tasks, "file").mapInPandas(_moves(config), ATTEMPT)
    done.write.mode("overwrite").parquet(_path(config, "attempts", number))
    failed = read_attempts(spark, config, number).where("outcome = 'failure'")
    again = failed.select("file", F.col("attempt").alias("attempts"), (F.col("finished_at") + F.lit(config.period)).alias("due_at"))
    later = plan.where("NOT is_due").select("file", "attempts", "due_at")
    later.unionByName(again).write.mode("overwrite").parquet(_path(config, "waiting", number))
    for kind in ("plan", "waiting"):
        if number > KEEP:
            delete_folder(spark, _path(config, kind, number - KEEP))


def _moves(config: Recovery):
    target, failed, put = config.target.rstrip("/"), config.failed, config.put

    def move(row) -> tuple:
        file = row["file"]
        try:
            if row["status"] != "ok":
                return "corrupt", move_into(file, failed), None
            location = object_name(target, row["event_type"], row["date"], row["hour"], file)
            # A file that is gone was put and removed by an earlier attempt at this plan.
            if is_file(file) or not is_file(location):
                put(file, location)
                remove_file(file)
            return "success", location, None
        except Exception as error:
            return "failure", None, f"{type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = []
            for row in pdf.to_dict("records"):
                start = time.monotonic()
                outcome, moved_to, message = move(row)
                done.append((outcome, moved_to, message, int((time.monotonic() - start) * 1000)))
            columns = list(zip(*done, strict=True)) or [(), (), (), ()]
            yield pdf.assign(
                attempt=pdf["attempts"] + 1, outcome=columns[0], moved_to=columns[1], message=columns[2],
                duration_ms=columns[3], finished_at=pdf["now"],
            )[[c.split()[0] for c in ATTEMPT.split(", ")]]

    return run
