"""The routing table as a versioned table that outlives failing refreshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.functions.transfer import is_committed, subfolders
from eventweir.operators.routing import all_tap_specs, build_flows, diff_flows, retain_cached_flows
from eventweir.session import delete_folder
from eventweir.sources.taps import read_discovery, read_static_taps

FLOW_SCHEMA = "event_type string, flow_id string, destinations array<string>, qos_enabled boolean, last_known bigint"


class FlowTable:
    """Flows from configuration and announcements, refreshed on demand.

    ``root`` is a shared folder; each refresh writes a new version there.
    ``announcements`` reads the current announcements (``properties``);
    ``static_taps`` is the configuration table.  Times are in one integer unit.
    The ``keep`` newest versions (two at least) stay for readers at work.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        announcements: Callable[[], DataFrame],
        static_taps: DataFrame,
        start_time: int,
        ttl: int = 0,
        allow_http: bool = False,
        keep: int = 16,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.announcements = announcements
        self.static_specs = read_static_taps(static_taps, F.lit(start_time).cast("bigint"))
        self.ttl = ttl
        self.keep = max(keep, 2)
        self.allow_http = allow_http
        self.last_error: Exception | None = None
        self.version = self._latest_version()

    def _latest_version(self) -> int:
        versions = [int(name.removeprefix("version=")) for name in subfolders(self.root) if name.startswith("version=")]
        return max((v for v in versions if is_committed(self._path(v))), default=0)

    def _path(self, version: int) -> str:
        return f"{self.root}/version={version:09d}"

    def flows(self, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], FLOW_SCHEMA)
        return self.spark.read.schema(FLOW_SCHEMA).parquet(self._path(version))

    def refresh(self, now: int) -> DataFrame:
        """Build the next version; on any failure the current one stays in use."""
        try:
            as_of = F.lit(now).cast("bigint")
            discovered = read_discovery(self.announcements(), as_of, self.allow_http)
            cached = retain_cached_flows(self.flows(), discovered, as_of, self.ttl)
            flows = build_flows(all_tap_specs(self.static_specs, discovered, cached))
            # "overwrite" replaces what a refresh that died may have left.
            flows.select(*[c.split()[0] for c in FLOW_SCHEMA.split(", ")]).write.mode("overwrite").parquet(self._path(self.version + 1))
            self.version += 1
            self.last_error = None
            if self.version > self.keep:
                delete_folder(self.spark, self._path(self.version - self.keep))
        except Exception as error:
            self.last_error = error
        return self.flows()

    def changes(self) -> DataFrame:
        """What the latest refresh changed."""
        return diff_flows(self.flows(max(self.version - 1, 0)), self.flows())
