"""Taking in events: accept, count, spool and route."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.functions.envelope import event_line, event_partition, problems
from eventweir.operators.batches import MAX_BATCH
from eventweir.operators.ingest import SINKS
from eventweir.operators.joins import small_table
from eventweir.operators.routing import batch_by_type
from eventweir.sinks.spool import write_spool

Sink = Callable[[DataFrame], None]


def accepted_events(events: DataFrame, accepted: Iterable[str]) -> DataFrame:
    """Events of accepted types; an empty accept list takes all.  The filter is
    on the bare column, so that a columnar source can skip data by it."""
    accepted = list(accepted)
    return events.where(F.col("type").isin(accepted)) if accepted else events


def hourly_partition_counts(events: DataFrame, accepted: Iterable[str]) -> DataFrame:
    """Accepted events per (type, UTC day, UTC hour)."""
    return (
        event_partition(accepted_events(events, accepted))
        .groupBy(F.col("type").alias("event_type"), "date", "hour")
        .agg(F.count("*").alias("n_events"))
    )


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per type and hour of event time.  Hours are never closed: there
    is no watermark, so on a stream late events still count."""
    return events.groupBy(F.col("type").alias("event_type"), F.window("timestamp", "1 hour").alias("_w")).agg(
        F.count("*").alias("n_events")
    ).select("event_type", F.date_format("_w.start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "n_events")


def judged_events(events: DataFrame, accepted: Iterable[str], type_pattern: str | None = None) -> DataFrame:
    """Accepted events with what is wrong with them in ``problems``.  Events of
    types that are not accepted are left out; what has no type stays, as an
    accept list cannot tell what it is."""
    accepted = list(accepted)
    if accepted:
        events = events.where(F.col("type").isin(accepted) | F.col("type").isNull())
    return events.withColumn("problems", problems(events.columns, type_pattern))


def ingest(
    events: DataFrame,
    accepted: Iterable[str],
    sinks: dict[str, Sink],
    process_type: str = "write",
    type_pattern: str | None = None,
) -> None:
    """Give the accepted events to each sink that the way they came in calls for.

    ``sinks`` maps ``spool`` and ``tap`` to what to do with events, and
    ``rejects`` to what to do with those that cannot be stored; their
    ``problems`` say why.  No other sink gets to see these.  They come first: a
    sink that refuses them does so before anything is stored or delivered."""
    judged = judged_events(events, accepted, type_pattern)
    if "rejects" in sinks:
        sinks["rejects"](judged.where(F.size("problems") > 0))
    wanted = judged.where(F.size("problems") == 0).drop("problems")
    for name in SINKS[process_type]:
        if name in sinks:
            sinks[name](wanted)


def post(events: DataFrame, sinks: dict[str, Sink]) -> None:
    """Give an application's own events to every sink, past the accept list.
    A failing sink does not keep the others from theirs; all errors are raised at the end."""
    errors = []
    for sink in sinks.values():
        try:
            sink(events)
        except Exception as error:
            errors.append(error)
    if errors:
        raise ExceptionGroup("posting failed", errors)


def spool_sink(root: str, batch_id: int | None = None, max_records: int = 0, codec: str = "snappy", target_bytes: int = 0) -> Sink:
    return lambda events: write_spool(events, root, max_records, codec, batch_id, target_bytes)


def delivery_batches(events: DataFrame, flows: DataFrame, seq: str, max_batch: int = MAX_BATCH) -> DataFrame:
    """Batches as ``deliver`` wants them, for types that have a flow: events in
    order, as JSON lines.  All flows of a type share its batches."""
    return line_batches(events.select("type", seq, event_line().alias("line")), flows, seq, max_batch)


def line_batches(lines: DataFrame, flows: DataFrame, seq: str, max_batch: int = MAX_BATCH) -> DataFrame:
    """The same for events that are lines already (``type, line``)."""
    targets = small_table(flows.select(F.col("event_type").alias("type")).distinct(), "types")
    batches = batch_by_type(lines, targets, seq, max_batch)
    return batches.select(F.col("type").alias("event_type"), "batch_id", "pos", "line")
