"""Continuous ingest, delivery and backlog on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventweir.functions.envelope import event_line
from eventweir.functions.transfer import is_committed, subfolders
from eventweir.operators.batches import MAX_BATCH, batch_numbers
from eventweir.operators.delivery import CAPACITY, delivery_outcome, play_tick
from eventweir.operators.ingest import batch_verdicts, inbound_counts
from eventweir.operators.joins import join_small, small_table
from eventweir.operators.routing import route_events
from eventweir.operators.running import Running, running_before
from eventweir.plans.flow_table import FlowTable
from eventweir.plans.ingest import ingest, line_batches, spool_sink
from eventweir.schema import FLOW, TAP_STATE
from eventweir.session import written_table
from eventweir.sinks.deliver import RETRY_DELAY, Transport, deliver, next_tap_state

MAX_BUFFER_TIME = "1 minute"


def run_ingest(
    stream: DataFrame,
    checkpoint: str,
    accepted: Iterable[str],
    spool_root: str,
    tap: Callable[[DataFrame, int], None] | None = None,
    process_type: str = "write",
    trigger: dict | None = None,
    reports: str | None = None,
    type_pattern: str | None = None,
    target_bytes: int = 0,
) -> StreamingQuery:
    """Spool every micro-batch and hand it to ``tap(events, batch_id)``.

    Below ``reports`` every micro-batch leaves, as ``batch=N``: ``rejects``,
    events that cannot be stored and why; ``counts`` per type and status; and
    ``verdicts``, the answer to each batch of events that says where it came in.
    Without it a micro-batch with such events fails, so that none gets lost,
    before any of it is spooled or handed on.  ``target_bytes`` rolls spool files by size.

    All happens under one checkpoint.  A repeated micro-batch replaces its own
    spool files; ``tap`` gets the batch id so that it can do likewise.  By
    default a micro-batch is what arrives in the maximum buffer time.
    """
    accepted = list(accepted)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            sinks = {"spool": spool_sink(spool_root, batch_id, target_bytes=target_bytes)}
            if tap is not None:
                sinks["tap"] = lambda events: tap(events, batch_id)
            sinks["rejects"] = lambda events: _keep_rejects(events, reports, batch_id)
            ingest(batch, accepted, sinks, process_type, type_pattern)
            if reports is not None:
                readable = batch.where("corrupt_body is null") if "corrupt_body" in batch.columns else batch
                _store(inbound_counts(readable, accepted, process_type), reports, "counts", batch_id)
                if "batch_id" in batch.columns:
                    _store(batch_verdicts(readable, accepted), reports, "verdicts", batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": MAX_BUFFER_TIME})).start()


def _keep_rejects(events: DataFrame, reports: str | None, batch_id: int) -> None:
    if reports is not None:
        _store(events, reports, "rejects", batch_id)
    elif events.take(1):
        raise ValueError("events that cannot be stored came in; name a folder for reports to keep them")


def routed_table_tap(table: FlowTable, out: str, now: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """A tap that refreshes the routing table for every micro-batch and stores
    the routed events as ``out/batch=N``."""

    def tap(events: DataFrame, batch_id: int) -> None:
        flows = table.refresh(now())
        route_events(events, flows, stored=True).write.mode("overwrite").parquet(f"{out}/batch={batch_id:09d}")

    return tap


WAITING = "event_type string, flow_id string, qos_enabled boolean, seq bigint, line string"


def delivery_tap(
    table: FlowTable,
    transport: Transport,
    root: str,
    now: Callable[[], int],
    max_batch: int = MAX_BATCH,
    capacity: int | None = None,
    retry_count: int = 0,
    retry_delay: float = RETRY_DELAY,
) -> Callable[[DataFrame, int], None]:
    """A tap that delivers every micro-batch to the flows of the moment.

    Each micro-batch first sends what earlier ones could not deliver, then its
    own events; what is lost waits for the next one, which is the next round of
    retries, so no task sleeps unless ``retry_count`` asks for it.  With a ``capacity`` no
    more events than that wait per flow, and ``drops`` counts, per flow and
    micro-batch, those that found no room.  A flow that is gone or changed its retry setting loses what
    waits for it.  Below ``root``, by micro-batch: ``attempts``, ``waiting`` and
    ``state`` (taps that answered, events dropped since the last success).  A
    repeated micro-batch starts from the state before it.
    """

    def tap(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        flows = table.refresh(now())
        before = _last_before(f"{root}/state", batch_id)

        def stored(kind: str, schema: str) -> DataFrame | None:
            return None if before is None else spark.read.schema(schema).parquet(_batch_path(root, kind, before))

        def send(batches: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            attempts = deliver(batches, flows, transport, state, retry_count, retry_delay)
            return attempts, small_table(next_tap_state(attempts, flows, state), "tap-state")

        state = stored("state", TAP_STATE)
        waiting, old_attempts = stored("waiting", WAITING), None
        if waiting is not None:
            waiting = join_small(waiting, flows.select(*FLOW, "qos_enabled"), [*FLOW, "qos_enabled"], ["seq"], "left_semi")
            waiting = written_table(batch_numbers(waiting, FLOW, "seq", max_batch), "waiting")
            old_attempts, state = send(waiting, state)

        # Ids of rows differ from run to run, so they are stored with the lines.
        lines = events.select("type", F.monotonically_increasing_id().alias("seq"), event_line().alias("line"))
        fresh = written_table(line_batches(written_table(lines, "lines"), flows, "seq", max_batch), "fresh")
        attempts, state = send(fresh, state)

        lost = [_lost_lines(fresh, attempts, flows, max_batch, ["event_type"]).withColumn("again", F.lit(1))]
        log = [attempts.withColumn("again", F.lit(False))]
        if waiting is not None:
            lost.append(_lost_lines(waiting, old_attempts, flows, max_batch, FLOW).withColumn("again", F.lit(0)))
            log.append(old_attempts.withColumn("again", F.lit(True)))
        # What was sent again goes to the tail before what came later.
        queue = reduce(DataFrame.unionByName, lost)
        counts = queue.where("again = 0").groupBy(*FLOW).agg(F.count("*").alias("_earlier"))
        queue = _renumber(queue, small_table(counts, "earlier"))
        if capacity is not None:
            queue = written_table(queue, "queue")
            dropped = queue.where(F.col("seq") >= capacity).groupBy(*FLOW).agg(F.count("*").alias("n_dropped"))
            _store(dropped, root, "drops", batch_id)
            queue = queue.where(F.col("seq") < capacity)
        _store(queue.select(*[c.split()[0] for c in WAITING.split(", ")]), root, "waiting", batch_id)
        _store(reduce(DataFrame.unionByName, log), root, "attempts", batch_id)
        _store(state, root, "state", batch_id)

    return tap


def _batch_path(root: str, kind: str, batch_id: int) -> str:
    return f"{root}/{kind}/batch={batch_id:09d}"


def _store(df: DataFrame, root: str, kind: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(_batch_path(root, kind, batch_id))


def _last_before(root: str, batch_id: int) -> int | None:
    """Latest finished micro-batch before this one."""
    names = (int(name.removeprefix("batch=")) for name in subfolders(root) if name.startswith("batch="))
    earlier = sorted((n for n in names if n < batch_id), reverse=True)
    return next((n for n in earlier if is_committed(f"{root}/batch={n:09d}")), None)


def _lost_lines(batches: DataFrame, attempts: DataFrame, flows: DataFrame, max_batch: int, keys: list[str]) -> DataFrame:
    """Events of lost batches, per flow, in their order."""
    lost = delivery_outcome(attempts, FLOW).where("status = 'lost'").select(*FLOW, "batch_id")
    lost = small_table(lost.join(flows.select(*FLOW, "qos_enabled"), FLOW), "lost")
    found = join_small(batches.select(*keys, "batch_id", "pos", "line"), lost, [*keys, "batch_id"], ["pos"])
    seq = (F.col("batch_id") * max_batch + F.col("pos")).alias("_seq")
    return found.select(*FLOW, "qos_enabled", seq, "line")


def _renumber(queue: DataFrame, counts: DataFrame) -> DataFrame:
    """Number each flow's queue without gaps: what is sent again, then the rest."""
    placed = running_before(queue, [*FLOW, "again"], "_seq", {"_at": Running(F.lit(1).cast("bigint"))})
    placed = join_small(placed, counts, FLOW, ["_seq"], "left")
    return placed.withColumn("seq", F.col("_at") + F.when(F.col("again") == 1, F.coalesce("_earlier", F.lit(0))).otherwise(0))


def partial_counts(events: DataFrame, flow: str = "flow_id") -> DataFrame:
    """Arrivals per flow, counted within each task before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for pdf in batches:
            for name, n in pdf["flow_id"].value_counts().items():
                total[name] = total.get(name, 0) + int(n)
        yield pd.DataFrame({"flow_id": list(total), "arrivals": list(total.values())})

    return events.select(F.col(flow).alias("flow_id")).mapInPandas(count, "flow_id string, arrivals bigint")


def stream_backlog(
    routed: DataFrame, capacity: int = CAPACITY, max_batch: int = MAX_BATCH, throttle_ms: int | None = None
) -> DataFrame:
    """The bounded queue of each flow over a stream of routed events; a
    micro-batch with events of the flow is a tick.  With ``throttle_ms`` a flow
    that gets no events for so long has a tick without arrivals, until its queue
    is empty.  The backlog lives in the query's checkpoint and so survives restarts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrivals = 0 if state.hasTimedOut else sum(int(pdf["arrivals"].sum()) for pdf in frames)
        backlog, tick = state.get if state.exists else (0, 0)
        accepted, dropped, sent, _, backlog = play_tick(backlog, arrivals, False, 0, capacity, max_batch)
        state.update((backlog, tick + 1))
        if throttle_ms is not None and backlog > 0:
            state.setTimeoutDuration(throttle_ms)
        yield pd.DataFrame(
            {
                "flow_id": [key[0]],
                "tick": [tick],
                "accepted": [accepted],
                "overflow_dropped": [dropped],
                "sent": [sent],
                "backlog": [backlog],
            }
        )

    return (
        partial_counts(routed)
        .groupBy("flow_id")
        .applyInPandasWithState(
            step,
            "flow_id string, tick bigint, accepted bigint, overflow_dropped bigint, sent bigint, backlog bigint",
            "backlog bigint, tick bigint",
            "append",
            GroupStateTimeout.NoTimeout if throttle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
