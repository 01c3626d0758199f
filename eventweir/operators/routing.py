"""The routing table: which flows exist, where they deliver, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.uris import audit_result, uri_problem
from eventweir.operators.batches import MAX_BATCH, batch_numbers
from eventweir.operators.joins import join_small, small_table
from eventweir.schema import FLOW

TAP_SPEC = ["event_type", "flow_id", "uri", "qos", "last_known"]


def all_tap_specs(static: DataFrame, discovered: DataFrame, cached: DataFrame) -> DataFrame:
    """Bag union in this order; ``seq`` tells a later source from an earlier one."""
    tagged = [
        df.select(*TAP_SPEC, F.lit(source).alias("source"), F.lit(seq).alias("seq"))
        for seq, (source, df) in enumerate([("static", static), ("discovered", discovered), ("cached", cached)])
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def build_flows(specs: DataFrame) -> DataFrame:
    """One row per flow: distinct destinations, retried when any spec asks for
    it, last known as the last source says."""
    return specs.groupBy(*FLOW).agg(
        F.array_sort(F.collect_set("uri")).alias("destinations"),
        F.max(F.col("qos") == "retry").alias("qos_enabled"),
        F.max(F.struct("seq", "last_known"))["last_known"].alias("last_known"),
    )


def retain_cached_flows(old_flows: DataFrame, discovered: DataFrame, now: Column, ttl) -> DataFrame:
    """Tap specs of old flows that discovery no longer names and that are
    younger than ``ttl`` (same unit as ``last_known``; 0 turns this off).

    The cache works per flow: a vanished URI of a flow that is still announced
    is gone at once.
    """
    young = (F.col("last_known") + F.lit(ttl) > now) if ttl else F.lit(False)
    gone = old_flows.join(discovered.select(*FLOW).distinct(), FLOW, "left_anti").where(young)
    return gone.select(
        *FLOW,
        F.explode("destinations").alias("uri"),
        F.when(F.col("qos_enabled"), "retry").otherwise("best_effort").alias("qos"),
        "last_known",
    )


def diff_flows(old: DataFrame, new: DataFrame) -> DataFrame:
    """What has to happen to each flow's queue and taps.

    CREATE: not there before.  RECREATE: retry setting changed, the queue
    starts afresh.  RETARGET: other destinations, the queue stays.  KEEP.
    TERMINATE: gone, queue deleted.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *FLOW,
            F.col("qos_enabled").alias(f"{name}_qos"),
            F.array_sort(F.array_distinct("destinations")).alias(f"{name}_destinations"),
        )

    both = side(old, "old").join(side(new, "new"), FLOW, "full_outer")
    action = (
        F.when(F.col("old_qos").isNull(), "CREATE")
        .when(F.col("new_qos").isNull(), "TERMINATE")
        .when(F.col("old_qos") != F.col("new_qos"), "RECREATE")
        .when(~F.col("old_destinations").eqNullSafe(F.col("new_destinations")), "RETARGET")
        .otherwise("KEEP")
    )
    return both.withColumn("action", action)


def route_events(
    events: DataFrame, flows: DataFrame, spread_by: tuple[str, ...] = ("uuid",), stored: bool = False
) -> DataFrame:
    """Copy every event to each flow of its type; types without a flow vanish.

    Only the flow's key and retry setting travel with the copies, not its
    destinations.  ``stored`` says that ``flows`` is read from files and need
    not be stored before it is measured and joined."""
    return _copy_to_flows(events, _targets(flows, stored), spread_by)


def _targets(flows: DataFrame, stored: bool = False) -> DataFrame:
    targets = flows.select(F.col("event_type").alias("type"), "flow_id", "qos_enabled")
    return targets if stored else small_table(targets, "targets")


def _copy_to_flows(events: DataFrame, targets: DataFrame, spread_by: tuple[str, ...]) -> DataFrame:
    return join_small(events, targets, ["type"], list(spread_by))


def batch_by_flow(events: DataFrame, flows: DataFrame, seq: str, max_batch: int = MAX_BATCH) -> DataFrame:
    """Route events and cut each flow's queue into FIFO batches.

    All flows of a type see the same events in the same order, so events are
    numbered once per type and copied to the flows afterwards."""
    targets = _targets(flows)
    return _copy_to_flows(batch_by_type(events, targets, seq, max_batch), targets, (seq,))


def batch_by_type(events: DataFrame, targets: DataFrame, seq: str, max_batch: int = MAX_BATCH) -> DataFrame:
    """FIFO batches of the events of each type that has a flow (``targets.type``)."""
    wanted = targets.select("type").distinct()
    return batch_numbers(join_small(events, wanted, ["type"], [seq]), ["type"], seq, max_batch)


def audit_tap_uris(uris: DataFrame, schemes: tuple[str, ...] = ("http", "https")) -> DataFrame:
    """Each distinct offending URI per flow, with the ``problem`` it has."""
    return (
        uris.withColumn("problem", uri_problem(F.col("uri"), schemes))
        .where("problem IS NOT NULL")
        .select("flow_id", "uri", "problem")
        .distinct()
    )


def audit_flows(uris: DataFrame, schemes: tuple[str, ...] = ("http", "https")) -> DataFrame:
    """Verdict per flow: counts of distinct offending URIs; a flow without any is ok."""
    distinct = (
        uris.withColumn("problem", uri_problem(F.col("uri"), schemes))
        .groupBy("flow_id", F.when(F.col("problem").isNotNull(), F.col("uri")).alias("bad_uri"))
        .agg(F.max("problem").alias("problem"))
    )
    return distinct.groupBy("flow_id").agg(
        F.coalesce(F.bool_and(F.col("problem").isNull()), F.lit(True)).alias("ok"),
        F.count_if(F.col("problem") == "syntax").alias("n_invalid_syntax"),
        F.count_if(F.col("problem") == "scheme").alias("n_invalid_scheme"),
    )


def audit_messages(problems: DataFrame) -> DataFrame:
    """The message for each flow that has offending URIs (output of
    ``audit_tap_uris``).  A message names all of them, so use it on flows whose
    URIs are configuration, not data."""
    result = audit_result(F.col("syntax"), F.col("scheme"))
    return (
        problems.groupBy("flow_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("problem") == "syntax", F.col("uri")))).alias("syntax"),
            F.array_sort(F.collect_list(F.when(F.col("problem") == "scheme", F.col("uri")))).alias("scheme"),
        )
        .select("flow_id", result["message"].alias("message"))
    )
