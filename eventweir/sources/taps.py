"""Tap specs from announcements and from configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.functions.uris import audit_uri_list, parse_qos, valid_uri

# Keys of an announcement's property map.
EVENT_TYPE, FLOW_ID, HTTP, HTTPS, QOS = "eventType", "flowId", "http", "https", "qos.delivery"

# Schemes a flow's configured URIs may have.
SCHEMES = (HTTP, HTTPS)

# What is wrong with a static flow key.
ONE_SEPARATOR = "Flow key must have a single @ character"
NOT_EMPTY = "Elements separate by @ cannot be empty"


def read_discovery(df: DataFrame, now: Column, allow_http: bool = False) -> DataFrame:
    """One tap spec per usable announcement (``properties map<string,string>``).

    HTTPS is preferred, HTTP only used when allowed; announcements without a
    type, a flow or a usable URI are skipped.
    """
    props = F.col("properties")
    uri = valid_uri(props[HTTPS])
    if allow_http:
        uri = F.coalesce(uri, valid_uri(props[HTTP]))
    specs = df.select(props[EVENT_TYPE].alias("event_type"), props[FLOW_ID].alias("flow_id"), uri.alias("uri"), props[QOS].alias("_qos"), now.alias("last_known"))
    usable = specs.where("event_type <> '' AND flow_id <> '' AND uri IS NOT NULL")
    return usable.select("event_type", "flow_id", "uri", parse_qos(F.col("_qos")).alias("qos"), "last_known")


def read_static_taps(df: DataFrame, start_time: Column) -> DataFrame:
    """One tap spec per distinct URI of configured flows (``flow_key, uris, qos_delivery``).

    The key is ``type@flow``, the URIs a comma-separated list; blanks around
    either are dropped.  A key of another form, a flow without URIs or a URI
    that does not parse or has another scheme than HTTP or HTTPS is an error.
    """
    tokens = F.transform(F.split(F.coalesce("flow_key", F.lit("")), "@"), _strip)
    uris = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("uris", F.lit("")), ","), _strip), lambda u: u != ""))

    audit = audit_uri_list(uris, SCHEMES)

    def invalid(reason: str) -> Column:
        return F.raise_error(F.concat(F.lit("Invalid flow key: "), F.coalesce("flow_key", F.lit("null")), F.lit(f"; {reason}")))

    key = (
        F.when(F.size(tokens) != 2, invalid(ONE_SEPARATOR))
        .when((tokens[0] == "") | (tokens[1] == ""), invalid(NOT_EMPTY))
        .otherwise(tokens)
    )
    listed = (
        F.when(F.size(uris) == 0, F.raise_error(F.concat(F.lit("uris may not be empty: "), F.col("flow_key"))))
        .when(~audit["ok"], F.raise_error(audit["message"]))
        .otherwise(uris)
    )
    specs = df.select(key.alias("_key"), F.explode(listed).alias("uri"), parse_qos(F.col("qos_delivery")).alias("qos"))
    return specs.select(F.col("_key")[0].alias("event_type"), F.col("_key")[1].alias("flow_id"), "uri", "qos", start_time.alias("last_known"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
