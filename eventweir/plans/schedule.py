"""Combining event types when they are due, by any number of schedulers.

A type seen for the first time is due at once, later one delay after its last
run ended.  Whoever creates the claim to a type's next run has it; types that
others run are left to them, so runs of several types go side by side, each in
a pass of its own.  The claim of a run that has not ended within the lease
counts for nothing any more.  Claims are small files below ``root``, one folder
per type; the number of types is that of the folders of the staging area.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.transfer import create_exclusive, file_names, read_small, remove_file
from eventweir.plans.combine import CombineConfig, run_combine
from eventweir.sources.listing import event_types

#: Seconds from the end of a type's run to its next.
DELAY = 300
#: Seconds after which a run that has not ended counts as dead.
LEASE = 6 * 3600


def run_due(
    spark: SparkSession,
    config: CombineConfig,
    root: str,
    as_of: dt.datetime,
    delay: int = DELAY,
    lease: int = LEASE,
    announce: Callable[[DataFrame], None] | None = None,
    ended: Callable[[], dt.datetime] | None = None,
) -> DataFrame:
    """Combine all types that are due; ``event_type, status, n_placed, n_written, message``.

    Types claimed together share a pass, urgent ones first.  If that fails, they
    are run one by one, so that a type that fails (``failed``) stops no other;
    it is due again after the delay.  ``ended`` tells when a run ends, by
    default it is ``as_of``.
    """
    at = _seconds(as_of)
    ours = claim_due(config, root, at, delay, lease)
    done: list[tuple] = []
    try:
        if ours:
            done = _combine(spark, config, as_of, sorted(ours), announce)
    except Exception:
        for kind in _by_priority(config, ours):
            try:
                done += _combine(spark, config, as_of, [kind], announce)
            except Exception as error:
                done.append((kind, "failed", 0, 0, f"{type(error).__name__}: {error}"))
    finally:
        end = _seconds(ended()) if ended else at
        for kind, number in ours.items():
            create_exclusive(f"{_folder(root, kind)}/{number:09d}.ended", json.dumps({"at": end}).encode())
            _forget(root, kind, number)
    return spark.createDataFrame(done, "event_type string, status string, n_placed bigint, n_written bigint, message string")


def claim_due(config: CombineConfig, root: str, at: int, delay: int = DELAY, lease: int = LEASE) -> dict[str, int]:
    """Claim the next run of every type that is due; the numbers of the runs that are ours."""
    ours = {}
    for kind in event_types(config.staging_root):
        last, ended = _last_run(root, kind)
        if last:
            since = at - json.loads(read_small(f"{_folder(root, kind)}/{last:09d}.{'ended' if ended else 'claimed'}"))["at"]
            if since < (delay if ended else lease):
                continue
        claim = json.dumps({"at": at, "by": config.node}).encode()
        if create_exclusive(f"{_folder(root, kind)}/{last + 1:09d}.claimed", claim):
            ours[kind] = last + 1
    return ours


def _combine(spark, config, as_of, kinds: list[str], announce) -> list[tuple]:
    result = run_combine(spark, config, as_of, kinds, announce)
    # A row per type of this pass.
    placed = dict(result.placed.groupBy("event_type").count().collect())
    written = result.log.where("status = 'combined'").select(_type_of(config, F.col("location")).alias("event_type"))
    written = dict(written.groupBy("event_type").count().collect())
    return [(k, "combined", placed.get(k, 0), written.get(k, 0), None) for k in kinds]


def _type_of(config: CombineConfig, location):
    return F.substring_index(F.substr(location, F.lit(len(config.target_root.rstrip("/")) + 2)), "/", 1)


def _by_priority(config: CombineConfig, kinds) -> list[str]:
    rank = {**dict.fromkeys(config.low_priority, 2), **dict.fromkeys(config.high_priority, 0)}
    return sorted(kinds, key=lambda k: (rank.get(k, 1), k))


def _folder(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/type={kind}"


def _last_run(root: str, kind: str) -> tuple[int, bool]:
    """Number of a type's last run, 0 for none, and whether it has ended."""
    names = file_names(_folder(root, kind))
    last = max((int(n.partition(".")[0]) for n in names), default=0)
    return last, f"{last:09d}.ended" in names


def _forget(root: str, kind: str, number: int) -> None:
    """Remove the files of runs before the last one."""
    for name in file_names(_folder(root, kind)):
        if int(name.partition(".")[0]) < number - 1:
            try:
                remove_file(f"{_folder(root, kind)}/{name}")
            except FileNotFoundError:  # another scheduler was faster
                pass


def _seconds(at: dt.datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or dt.timezone.utc).timestamp())
