"""Committing manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.transfer import create_exclusive, is_committed, read_small
from eventweir.operators.combine import WRITER_LEASE_MS
from eventweir.schema import GROUP
from eventweir.session import written_table
from eventweir.sources.manifests import FOLDED, latest_objects, manifest_view, stored_rows

#: Below the manifest's root, hidden from readers of its passes.
CLAIMS = "_claims"
#: Snapshots that are kept.
SNAPSHOTS = 3


def pass_name(now_ms: int) -> str:
    """A name for a pass that no other run takes; names sort by time."""
    return f"{now_ms:015d}-{uuid.uuid4().hex[:12]}"


def claim_groups(proposed: DataFrame, root: str, name: str, now_ms: int, lease_ms: int = WRITER_LEASE_MS) -> DataFrame:
    """May the pass ``name`` replace the version it read (``read_version``) of each group.

    A version of a group is replaced by one pass only: by the one that creates
    the claim to it.  ``status`` is ``commit`` for that one and ``conflict`` for
    others.  If the pass that holds a claim has not committed within the lease,
    it counts as dead and the claim passes on, once for each time that happens.
    A repeated task finds its own claims.  Claims are made when this returns.
    """

    def take(row) -> str:
        group = "/".join(quote(str(row[c]), safe="") for c in GROUP)
        attempt = 0
        while True:
            claim = f"{root.rstrip('/')}/{CLAIMS}/{group}/{int(row['read_version']):012d}.{attempt:04d}"
            if create_exclusive(claim, json.dumps({"pass": name, "at": now_ms}).encode()):
                return "commit"
            holder = json.loads(read_small(claim))
            if holder["pass"] == name:
                return "commit"
            if is_committed(f"{root.rstrip('/')}/pass={holder['pass']}") or now_ms - holder["at"] < lease_ms:
                return "conflict"
            attempt += 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(status=[take(row) for row in pdf.to_dict("records")])

    rows = proposed.select(*GROUP, F.col("read_version").cast("bigint"))
    schema = "event_type string, date string, hour string, size_class string, read_version bigint, status string"
    return written_table(rows.repartition(*GROUP).mapInPandas(run, schema), "claims")


def write_manifest(manifest: DataFrame, root: str, name: int | str) -> str:
    """Add the changed objects of one pass as ``root/pass=NAME/date=...``.

    A name can be used once; a second writer of the same pass fails.  Readers
    see the pass when all of it is there.  Write the manifest before the data: a
    run that dies in between leaves objects that are missing or too small, and
    the next pass rewrites those.
    """
    path = f"{root}/pass={f'{name:012d}' if isinstance(name, int) else name}"
    # An object's parts are one row; spread rows so that no file collects a whole day.
    manifest.hint("rebalance", F.col("date")).write.mode("errorifexists").partitionBy("date").parquet(path)
    return path


def write_snapshot(spark: SparkSession, root: str, name: str, keep: int = SNAPSHOTS) -> str:
    """Store the current manifest as one folder, so that reading opens it and the
    passes after it instead of every pass there ever was.

    The snapshot names the passes it holds; a pass that ends while it is written
    is not among them and stays in the tail.  Two writers may each store one,
    either is right.  The ``keep`` newest finished ones stay for readers at work.
    """
    view = manifest_view(spark, root)
    folded = sorted({*view.folded, *(p.rsplit("/pass=", 1)[1] for p in view.tail)})
    # Names sort by what they hold, not by clocks.
    folder = f"snapshot={len(folded):012d}-{name}"
    if not create_exclusive(f"{root.rstrip('/')}/{FOLDED}/{folder}", json.dumps(folded).encode()):
        raise FileExistsError(f"{root}/{folder}")
    rows = latest_objects(stored_rows(spark, root, view))
    path = f"{root.rstrip('/')}/{folder}"
    rows.hint("rebalance", F.col("date")).write.mode("errorifexists").partitionBy("date").parquet(path)
    top = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    snapshots = sorted(s.getPath().getName() for s in system.listStatus(top) if s.getPath().getName().startswith("snapshot="))
    finished = [s for s in snapshots if is_committed(f"{root.rstrip('/')}/{s}")]
    for old in finished[:-keep]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{old}"), True)
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{FOLDED}/{old}"), False)
    return path
