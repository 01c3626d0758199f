"""What became of delivered batches, and of the queues they come from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventweir.operators.batches import MAX_BATCH
from eventweir.operators.joins import join_small, small_table
from eventweir.operators.running import Running, running_before

CAPACITY = 250_000


def attempt_result(status_code: Column) -> Column:
    """``delivered`` (2xx), ``rejected`` (4xx), or NULL: try the next tap."""
    return F.when(status_code.between(200, 299), "delivered").when(status_code.between(400, 499), "rejected")


def delivery_outcome(attempts: DataFrame, flow: list[str] = ["flow_id"]) -> DataFrame:
    """One row per batch.  The first 2xx or 4xx ends it; attempts recorded
    after that are ignored.  Without one the batch is ``lost`` and has no URI."""
    result = attempt_result(F.col("status_code"))
    ended = F.when(result.isNotNull(), F.struct("attempt_no", result.alias("status"), "uri"))
    return (
        attempts.groupBy(*flow, "batch_id")
        .agg(
            F.min(ended).alias("_end"),
            F.max("attempt_no").alias("_last"),
            F.max("n_events").alias("n_events"),
        )
        .select(
            *flow,
            "batch_id",
            F.coalesce(F.col("_end.status"), F.lit("lost")).alias("status"),
            F.col("_end.uri").alias("uri"),
            F.coalesce(F.col("_end.attempt_no"), F.col("_last")).alias("attempts"),
            "n_events",
        )
    )


def _counted_attempts(attempts: DataFrame, flow: list[str]) -> DataFrame:
    """Attempts up to the one that ended their batch."""
    batch = Window.partitionBy(*flow, "batch_id")
    ended = F.when(attempt_result(F.col("status_code")).isNotNull(), F.col("attempt_no"))
    return attempts.withColumn("_end", F.min(ended).over(batch)).where(
        F.col("_end").isNull() | (F.col("attempt_no") <= F.col("_end"))
    )


def dropped_header(
    attempts: DataFrame, drops: DataFrame | None = None, flow: list[str] = ["flow_id"]
) -> DataFrame:
    """Adds ``dropped_messages`` to the attempts that count: events dropped
    since the flow's last successful attempt.

    These are overflow drops (``drops``: flow, ``batch_id`` they came before,
    ``n_dropped``) and the events of lost and rejected batches.  All attempts
    of a batch report the same number, so it is carried from batch to batch.
    """
    counted = _counted_attempts(attempts, flow)
    delivered = F.coalesce(F.max(F.col("status_code").between(200, 299)), F.lit(False))
    batches = counted.groupBy(*flow, "batch_id").agg(
        delivered.alias("_delivered"), F.max("n_events").cast("bigint").alias("_n"), F.lit(1).alias("_kind")
    )
    if drops is not None:
        overflow = drops.groupBy(*flow, "batch_id").agg(F.sum("n_dropped").cast("bigint").alias("_n"))
        batches = batches.unionByName(overflow.withColumns({"_delivered": F.lit(False), "_kind": F.lit(0)}))
    carried = Running(F.when(F.col("_delivered"), F.lit(0).cast("bigint")).otherwise(F.col("_n")), reset=F.col("_delivered"))
    batches = running_before(batches, flow, "batch_id", {"dropped_messages": carried}, ("_kind",))
    batches = batches.where("_kind = 1").select(*flow, "batch_id", "dropped_messages")
    return counted.drop("_end").join(batches, [*flow, "batch_id"])


def first_batch_flag(
    attempts: DataFrame, tap_epochs: DataFrame | None = None, flow: list[str] = ["flow_id"]
) -> DataFrame:
    """Adds ``first_batch``: no 2xx yet from this tap since it was (re)added.

    ``tap_epochs`` (flow, ``uri``, ``batch_id`` before which the tap was added)
    starts the question anew.
    """
    tap = [*flow, "uri"]
    counted = _counted_attempts(attempts, flow).drop("_end")
    if tap_epochs is None:
        staged = counted.withColumn("_epoch", F.lit(None).cast("bigint"))
    else:
        added = tap_epochs.select(*tap, "batch_id", F.lit(0).alias("_kind")).distinct()
        both = counted.withColumn("_kind", F.lit(1)).unionByName(added, allowMissingColumns=True)
        latest = Running(F.when(F.col("_kind") == 0, F.col("batch_id")), "max")
        staged = running_before(both, tap, "batch_id", {"_epoch": latest}, ("_kind", "attempt_no"))
        staged = staged.where("_kind = 1").drop("_kind")
    staged = staged.withColumn("_epoch", F.coalesce("_epoch", F.lit(-(2**63)).cast("bigint")))
    established = staged.where(F.col("status_code").between(200, 299))
    established = established.groupBy(*tap, "_epoch").agg(F.min(F.struct("batch_id", "attempt_no")).alias("_first"))
    established = small_table(established, "established")
    flagged = join_small(staged, established, [*tap, "_epoch"], ["batch_id", "attempt_no"], "left")
    here = F.struct("batch_id", "attempt_no")
    return flagged.withColumn("first_batch", F.coalesce(here <= F.col("_first"), F.lit(True))).drop("_epoch", "_first")


def outbound_counts(outcomes: DataFrame, drops: DataFrame | None = None) -> DataFrame:
    """Events per (type, flow, URI, status).  Lost and dropped events have no URI."""
    columns = ["event_type", "flow_id", "uri", "status"]
    counts = outcomes.groupBy(*columns).agg(F.sum("n_events").alias("n_events"))
    if drops is None:
        return counts
    dropped = drops.groupBy("event_type", "flow_id").agg(F.sum("n_dropped").alias("n_events"))
    dropped = dropped.withColumns({"uri": F.lit(None).cast("string"), "status": F.lit("dropped")})
    return counts.unionByName(dropped.where("n_events > 0"))


def backlog_metrics(queue_log: DataFrame, seq: str = "read_no") -> DataFrame:
    """Counters as a reader sees them who resets them by reading.

    ``queue_log`` has running totals per flow at each read; the result has the
    growth since the read before, and the current size."""
    totals = ["enqueued", "dequeued", "dropped"]
    seen = running_before(
        queue_log, ["flow_id"], seq, {f"_{c}": Running(F.col(c), "max") for c in totals}
    )
    growth = [(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).cast("bigint").alias(c) for c in totals]
    return seen.select("flow_id", seq, *growth, (F.col("enqueued") - F.col("dequeued")).cast("bigint").alias("size"))


BACKLOG_BITS = 16


def bounded_backlog(arrivals: DataFrame, capacity: int = CAPACITY, max_batch: int = MAX_BATCH) -> DataFrame:
    """Each flow's bounded queue, tick by tick (``flow_id, tick, arrivals``,
    optionally ``failed`` and ``arrivals_sending``).

    In a tick arrivals are taken while there is room and the newest are
    dropped beyond it; then one batch is taken from the head.  While it is
    being sent ``arrivals_sending`` more may come.  A ``failed`` batch goes
    back to the tail and what no longer fits is discarded.

    Whatever happens in a tick, the new backlog is ``min(high, max(low, old +
    move))``, and such steps compose into one step of the same form.  So ranges
    of ticks are reduced on their own, a flow's ranges are walked, and each
    range is then replayed from its known start.
    """
    for column, default in (("failed", F.lit(False)), ("arrivals_sending", F.lit(0))):
        if column not in arrivals.columns:
            arrivals = arrivals.withColumn(column, default)
    ticks = arrivals.select(
        "flow_id",
        F.col("tick").cast("bigint").alias("tick"),
        F.col("arrivals").cast("bigint").alias("arrivals"),
        "failed",
        F.col("arrivals_sending").cast("bigint").alias("arrivals_sending"),
        F.shiftright(F.col("tick").cast("bigint"), BACKLOG_BITS).alias("_range"),
    )

    def reduce_range(pdf: pd.DataFrame) -> pd.DataFrame:
        step = None
        for row in pdf.sort_values("tick").itertuples(index=False):
            step = _then(step, _tick_step(row.arrivals, row.failed, row.arrivals_sending, capacity, max_batch))
        return pd.DataFrame([[pdf["flow_id"].iloc[0], pdf["_range"].iloc[0], *step]], columns=["flow_id", "_range", "move", "low", "high"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range")
        backlog, starts = 0, []
        for row in pdf.itertuples(index=False):
            starts.append(backlog)
            backlog = min(row.high, max(row.low, backlog + row.move))
        return pd.DataFrame({"flow_id": pdf["flow_id"], "_range": pdf["_range"], "_start": starts})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        backlog = int(pdf["_start"].iloc[0])
        out = []
        for row in pdf.itertuples(index=False):
            result = play_tick(backlog, row.arrivals, row.failed, row.arrivals_sending, capacity, max_batch)
            backlog = result[-1]
            out.append((row.flow_id, row.tick, *result))
        return pd.DataFrame(out, columns=["flow_id", "tick", "accepted", "overflow_dropped", "sent", "requeue_dropped", "backlog"])

    steps = ticks.groupBy("flow_id", "_range").applyInPandas(
        reduce_range, "flow_id string, _range bigint, move bigint, low bigint, high bigint"
    )
    starts = steps.groupBy("flow_id").applyInPandas(walk, "flow_id string, _range bigint, _start bigint")
    return (
        ticks.join(starts, ["flow_id", "_range"])
        .groupBy("flow_id", "_range")
        .applyInPandas(
            replay,
            "flow_id string, tick bigint, accepted bigint, overflow_dropped bigint, "
            "sent bigint, requeue_dropped bigint, backlog bigint",
        )
    )


def play_tick(backlog, arrivals, failed, sending, capacity, max_batch):
    accepted = min(arrivals, capacity - backlog)
    size = backlog + accepted
    batch = min(max_batch, size)
    late = min(sending, capacity - (size - batch))
    after = size - batch + late
    back = min(batch, capacity - after) if failed else 0
    return (
        accepted + late,
        arrivals + sending - accepted - late,
        0 if failed else batch,
        batch - back if failed else 0,
        after + back,
    )


def _tick_step(arrivals, failed, sending, capacity, max_batch):
    """The tick as (move, low, high)."""
    if failed:
        return arrivals + sending, 0, capacity
    low = min(sending, capacity)
    return (
        arrivals - max_batch + sending,
        low,
        max(low, min(capacity, capacity - max_batch + sending)),
    )


def _then(first, second):
    """One step that does ``first`` and then ``second``."""
    if first is None:
        return second
    (m1, l1, h1), (m2, l2, h2) = first, second
    return m1 + m2, min(h2, max(l2, l1 + m2)), min(h2, max(l2, h1 + m2))
