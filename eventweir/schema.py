"""Schemas and key columns shared by the operators."""

from pyspark.sql import types as T

# An event: fixed envelope, payload kept as JSON text.
ENVELOPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("data", T.StringType()),
    ]
)

# The same five fields as they appear in JSON; the timestamp stays text so an
# unparsable one can be told from a missing one.
ENVELOPE_TEXT = "type string, uuid string, host string, timestamp string, data string"

ENVELOPE_FIELDS = ENVELOPE.fieldNames()

# An (event type, UTC day, UTC hour) bucket, and a bucket's files of one size class.
BUCKET = ["event_type", "date", "hour"]
GROUP = [*BUCKET, "size_class"]

FLOW = ["event_type", "flow_id"]

STORED_OBJECT = "location string, etag string, size bigint, last_modified bigint"

# Manifest rows: one row per combined object, so no row grows with its bucket.
MANIFEST = (
    "event_type string, date string, hour string, size_class string, "
    "location_prefix string, version bigint, creator string, updated_ts bigint, "
    "ordinal bigint, location string, object_updated_ts bigint, "
    f"source_parts array<struct<{STORED_OBJECT}>>"
)

# Interchange form: one JSON document per (bucket, size class).
GROUP_DOCUMENT = (
    "locationPrefix string, version bigint, creator string, updatedTimestamp bigint, "
    "combinedObjects array<struct<location: string, updatedTimestamp: bigint, "
    "sourceParts: array<struct<location: string, etag: string, size: bigint, lastModified: bigint>>>>"
)

ATTEMPT = (
    "event_type string, flow_id string, batch_id bigint, attempt_no int, uri string, "
    "status_code int, n_events bigint, first_batch boolean, dropped_messages bigint"
)

# What delivery has to remember about a flow between runs.
TAP_STATE = "event_type string, flow_id string, established array<string>, dropped bigint"
