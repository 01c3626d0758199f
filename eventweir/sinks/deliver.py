"""Handing batches to consumers through a transport the caller supplies."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.operators.delivery import delivery_outcome
from eventweir.operators.joins import join_small, small_table
from eventweir.operators.running import Running, running_before
from eventweir.schema import ATTEMPT, FLOW
from eventweir.session import settings, written_table

# transport(uri, headers, lines) -> HTTP-like status code; raising counts as no answer
Transport = Callable[[str, dict, list], int]

# What the delivery-quality header says.
QOS_HEADER = "X-QoS"
FIRST_BATCH = "firstBatch"
DROPPED_MESSAGES = "droppedMessages={}"

RETRY_COUNT = 10
RETRY_DELAY = 30.0


def deliver(
    batches: DataFrame,
    flows: DataFrame,
    transport: Transport,
    tap_state: DataFrame | None = None,
    retry_count: int = RETRY_COUNT,
    retry_delay: float = RETRY_DELAY,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Send every batch (``event_type, batch_id, pos, line``) to each flow of its
    type and return the attempts.  With a ``flow_id`` column a batch goes to that flow only.

    The taps of a flow are tried in turn from a start that depends on the batch
    only; 2xx and 4xx end the batch.  What no tap of a flow that wants retries
    took is sent again in up to ``retry_count`` more rounds, ``retry_delay``
    seconds apart.  A round is a job over the batches that are due; between
    rounds the caller waits, and no task does.

    ``tap_state`` (flow, ``established`` URIs, ``dropped`` so far) comes from the
    attempts before this call: batches to a tap that is not established carry
    the first-batch mark, and the flow's first batch reports what was dropped.

    So the first round goes in two waves.  The first tries every tap that is not
    established with one batch, and reports drops; the few batches of a flow go
    one after the other, as failing over may lead them to the same tap, and the
    mark ends with a tap's first success.  The second sends the rest, all in
    parallel, and knows what the first established and lost.

    Delivery is at least once: a batch whose task is lost is sent again.
    Everything is sent, and the attempts are stored, when this returns.

    Only tables of flows and taps are broadcast.  What is due or waits for a
    round grows with the batches, so it is joined by shuffles.
    """
    targets = small_table(_targets(flows, tap_state), "targets")
    whole = _whole(batches)
    ready = _ready(whole, targets).withColumn("tried", F.lit(0))
    first = small_table(_pilots(ready, targets), "pilots")
    waves, state, rest = [], tap_state, ready
    if first.take(1):
        waves.append(_send_in_turn(join_small(ready, first, [*FLOW, "batch_id"], ["batch_id"], "left_semi"), targets, transport))
        state = small_table(next_tap_state(_ended(waves, flows, retry_count), flows, tap_state), "tap-state")
        rest = join_small(ready, first, [*FLOW, "batch_id"], ["batch_id"], "left_anti")
    waves.append(_send_wave(rest, flows, transport, state))
    for _ in range(retry_count):
        due = written_table(_lost(waves, flows.where("qos_enabled")), "due")
        if not due.take(1):
            break
        wait(retry_delay)
        state = small_table(next_tap_state(_ended(waves, flows, retry_count), flows, tap_state), "tap-state")
        waves.append(_send_wave(_ready(whole, targets, due), flows, transport, state))
    return reduce(DataFrame.unionByName, waves)


def _targets(flows: DataFrame, tap_state: DataFrame | None) -> DataFrame:
    """Flows with the taps that answered before and what was dropped since."""
    none, zero = F.expr("CAST(array() AS array<string>)"), F.lit(0).cast("bigint")
    targets = flows.select(*FLOW, "destinations", "qos_enabled")
    if tap_state is None:
        targets = targets.withColumns({"established": none, "dropped": zero})
    else:
        targets = targets.join(tap_state.select(*FLOW, "established", "dropped"), FLOW, "left")
        targets = targets.withColumns({"established": F.coalesce("established", none), "dropped": F.coalesce("dropped", zero)})
    return targets


def _start() -> Column:
    return F.pmod(F.xxhash64(*FLOW, "batch_id"), F.size("destinations"))


def _whole(batches: DataFrame) -> DataFrame:
    """Whole batches, stored.  A batch is bounded by the batch size, so it may become one row."""
    keys = FLOW if "flow_id" in batches.columns else ["event_type"]
    whole = batches.groupBy(*keys, "batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("entries"))
    return written_table(whole.select(*keys, "batch_id", F.col("entries.line").alias("lines")), "batches")


def _ready(whole: DataFrame, targets: DataFrame, due: DataFrame | None = None) -> DataFrame:
    """Whole batches for each flow they go to, or for those of ``due`` only, with their tries.

    Flows are joined to batches, not to events, and what is due before that, so
    that the lines of a batch move once however many flows want them."""
    keys, tried = [c for c in FLOW if c in whole.columns], []
    if due is not None:
        whole, keys, tried = whole.join(due, [*keys, "batch_id"]), FLOW, ["tried"]
    joined = join_small(whole, targets.select(*FLOW, "destinations"), keys, ["batch_id"])
    return joined.select(*FLOW, "batch_id", "lines", "destinations", _start().alias("start"), *tried)


def _pilots(ready: DataFrame, targets: DataFrame) -> DataFrame:
    """The first batch to each tap that is not established, and of each flow with drops."""
    state = targets.select(*FLOW, "established", "dropped")
    tried = join_small(ready.select(*FLOW, "batch_id", F.get("destinations", F.col("start").cast("int")).alias("uri")), state, FLOW, ["batch_id"])
    new = tried.where(~F.array_contains("established", F.col("uri"))).groupBy(*FLOW, "uri").agg(F.min("batch_id").alias("batch_id"))
    reporting = tried.where("dropped > 0").groupBy(*FLOW).agg(F.min("batch_id").alias("batch_id"))
    return new.select(*FLOW, "batch_id").union(reporting).distinct()


def _lost(waves: list[DataFrame], flows: DataFrame) -> DataFrame:
    """Batches of these flows that no tap took so far, and their tries."""
    outcomes = delivery_outcome(reduce(DataFrame.unionByName, waves), FLOW).where("status = 'lost'")
    return outcomes.join(flows.select(*FLOW), FLOW, "left_semi").select(*FLOW, "batch_id", F.col("attempts").alias("tried"))


def _ended(waves: list[DataFrame], flows: DataFrame, retry_count: int) -> DataFrame:
    """Attempts of batches that are done with; what will be sent again is not lost yet."""
    attempts = reduce(DataFrame.unionByName, waves)
    if not retry_count:
        return attempts
    waiting = _lost(waves, flows.where("qos_enabled")).drop("tried")
    return attempts.join(waiting, [*FLOW, "batch_id"], "left_anti")


ATTEMPT_COLUMNS = [c.split()[0] for c in ATTEMPT.split(", ")]


def _send_in_turn(pilots: DataFrame, targets: DataFrame, transport: Transport) -> DataFrame:
    """Send a few batches of every flow, one after the other: one a tap and one that reports drops."""
    joined = join_small(pilots, targets.select(*FLOW, "established", "dropped"), FLOW, ["batch_id"])

    def send(key, pdf):
        rows, established, dropped = [], set(pdf["established"].iloc[0]), int(pdf["dropped"].iloc[0])
        for batch in pdf.sort_values("batch_id").itertuples(index=False):
            rows.extend(_send_batch(batch, transport, established, dropped))
            status = rows[-1][5]
            if status is not None and 200 <= status <= 299:
                established.add(rows[-1][4])
                dropped = 0
            else:
                dropped += len(batch.lines)
        return pd.DataFrame(rows, columns=ATTEMPT_COLUMNS)

    return written_table(joined.groupBy(*FLOW).applyInPandas(send, ATTEMPT), "attempts")


def _send_wave(ready: DataFrame, flows: DataFrame, transport: Transport, tap_state: DataFrame | None) -> DataFrame:
    """Send the batches of one wave in parallel."""
    known = small_table(_targets(flows, tap_state).select(*FLOW, "established", "dropped"), "targets")
    first = small_table(ready.groupBy(*FLOW).agg(F.min("batch_id").alias("first_batch_id")), "first-batches")
    joined = join_small(join_small(ready, known, FLOW, ["batch_id"]), first, FLOW, ["batch_id"])
    report = F.when(F.col("batch_id") == F.col("first_batch_id"), F.col("dropped")).otherwise(0)

    def send(frames):
        for pdf in frames:
            rows = []
            for batch in pdf.itertuples(index=False):
                rows.extend(_send_batch(batch, transport, set(batch.established), int(batch.dropped)))
            yield pd.DataFrame(rows, columns=ATTEMPT_COLUMNS)

    # A row is a whole batch, so a task takes few rows at a time.
    with settings(ready.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="16"):
        return written_table(joined.withColumn("dropped", report).drop("first_batch_id").mapInPandas(send, ATTEMPT), "attempts")


def _send_batch(batch, transport: Transport, established: set[str], dropped: int) -> list[tuple]:
    """One round over the taps of a batch, up to the one that answers."""
    taps, start, lines = list(batch.destinations), int(batch.start), list(batch.lines)
    attempts: list[tuple] = []
    for uri in taps[start:] + taps[:start]:
        first = uri not in established
        marks = ([FIRST_BATCH] if first else []) + ([DROPPED_MESSAGES.format(dropped)] if dropped else [])
        try:
            status = int(transport(uri, {QOS_HEADER: marks} if marks else {}, lines))
        except Exception:
            status = None
        number = int(batch.tried) + len(attempts) + 1
        attempts.append((batch.event_type, batch.flow_id, batch.batch_id, number, uri, status, len(lines), first, dropped))
        if status is not None and (200 <= status <= 299 or 400 <= status <= 499):
            break
    return attempts


def next_tap_state(attempts: DataFrame, flows: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """What the next ``deliver`` has to know: taps that answered, and events
    dropped since the last success of each flow.

    Taps stay established only while they are destinations of their flow.
    """
    answered = attempts.where(F.col("status_code").between(200, 299)).groupBy(*FLOW).agg(F.collect_set("uri").alias("_answered"))
    outcomes = delivery_outcome(attempts, FLOW)
    delivered = F.col("status") == "delivered"
    # The state after the last batch is the state before a batch that follows it.
    lost = F.when(delivered, F.lit(0).cast("bigint")).otherwise(F.col("n_events"))
    steps = outcomes.select(*FLOW, "batch_id", delivered.alias("_ok"), lost.cast("bigint").alias("_lost"))
    ends = steps.groupBy(*FLOW).agg((F.max("batch_id") + 1).alias("batch_id"))
    ends = ends.withColumns({"_ok": F.lit(False), "_lost": F.lit(0).cast("bigint"), "_after": F.lit(True)})
    begins = flows.select(*FLOW, F.lit(-1).cast("bigint").alias("batch_id"))
    if previous is not None:
        begins = begins.join(previous.select(*FLOW, F.col("dropped").alias("_lost")), FLOW, "left")
        begins = begins.withColumn("_lost", F.coalesce("_lost", F.lit(0).cast("bigint")))
    else:
        begins = begins.withColumn("_lost", F.lit(0).cast("bigint"))
    begins = begins.withColumns({"_ok": F.lit(False), "_after": F.lit(False)})
    sequence = steps.withColumn("_after", F.lit(False)).unionByName(begins).unionByName(ends)
    carried = running_before(sequence, FLOW, "batch_id", {"dropped": Running(F.col("_lost"), reset=F.col("_ok"))})
    after = carried.where("_after").select(*FLOW, "dropped")

    state = flows.select(*FLOW, "destinations").join(answered, FLOW, "left").join(after, FLOW, "left")
    none = F.expr("CAST(array() AS array<string>)")
    if previous is None:
        known, dropped = none, F.lit(0).cast("bigint")
    else:
        before = previous.select(*FLOW, F.col("established").alias("_known"), F.col("dropped").alias("_dropped"))
        state = state.join(before, FLOW, "left")
        known, dropped = F.coalesce("_known", none), F.coalesce("_dropped", F.lit(0).cast("bigint"))
    reached = F.array_union(known, F.coalesce("_answered", none))
    return state.select(
        *FLOW,
        F.array_sort(F.array_intersect("destinations", reached)).alias("established"),
        F.coalesce("dropped", dropped).alias("dropped"),
    )
