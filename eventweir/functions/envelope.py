"""Column expressions over event envelopes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweir.schema import ENVELOPE_FIELDS

# The envelope rules and their messages.
TYPE_PATTERN = r"\A[A-Za-z][A-Za-z0-9]*\z"
IS_MISSING = "is missing"
MUST_BE_ALPHANUMERIC = "must be alphanumeric"

# What else keeps an event from being stored.
UNREADABLE, NO_OBJECT, NO_ARRAY = "is unreadable", "is no JSON object", "is no JSON array"

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _broken(condition: Column, field: str, message: str) -> Column:
    return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def violations(type_pattern: str | None = TYPE_PATTERN) -> Column:
    """Broken envelope rules of a row: ``array<struct<field, message>>``, empty when valid.

    All five fields must be there; the whole type must match ``type_pattern``,
    if there is one: a letter followed by letters and digits.  A missing type
    reports only that it is missing.
    """
    checks = [_broken(F.col(f).isNull(), f, IS_MISSING) for f in ENVELOPE_FIELDS]
    if type_pattern:
        checks.insert(1, _broken(~F.col("type").rlike(type_pattern), "type", MUST_BE_ALPHANUMERIC))
    return F.array_compact(F.array(*checks))


def problems(columns: Iterable[str], type_pattern: str | None = None) -> Column:
    """Why a row of ``columns`` cannot be stored, like ``violations``; empty when it can.

    Besides the envelope rules: the body it came in was readable, the timestamp
    was, and the payload is one JSON object."""
    checks = []
    readable = F.lit(True)
    if "corrupt_body" in columns:
        readable = F.col("corrupt_body").isNull()
        checks.append(_broken(~readable, "body", NO_ARRAY))
    if "timestamp_text" in columns:
        unread = F.col("timestamp").isNull() & F.col("timestamp_text").isNotNull()
        checks.append(_broken(unread, "timestamp", UNREADABLE))
    checks.append(_broken(F.col("data").isNotNull() & ~is_json_object(F.col("data")), "data", NO_OBJECT))
    found = F.array_compact(F.array(*checks))
    told = F.transform(found, lambda p: p["field"])
    rules = F.filter(violations(type_pattern), lambda v: ~F.array_contains(told, v["field"]))
    return F.when(readable, F.concat(found, rules)).otherwise(found)


def is_json_object(text: Column) -> Column:
    """True when the text is exactly one JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT") & one_json_value(text), F.lit(False))


def validate_envelope(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", violations())


def accepted_types(text: str | None) -> list[str]:
    """Parse a comma-separated accept list; blanks are dropped."""
    return sorted({t.strip() for t in (text or "").split(",")} - {""})


def accept_status(event_type: Column, accepted: Iterable[str]) -> Column:
    """``valid`` or ``unsupported``.  An empty accept list takes every type;
    with a non-empty one a missing type is unsupported."""
    accepted = list(accepted)
    if not accepted:
        return F.lit("valid")
    return F.when(event_type.isin(accepted), "valid").otherwise("unsupported")


def accept_types(df: DataFrame, accepted: Iterable[str]) -> DataFrame:
    return df.withColumn("status", accept_status(F.col("type"), accepted))


def utc_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def utc_hour(ts: Column) -> Column:
    return F.date_format(ts, "HH")


def bucket_path(event_type: Column, date: Column, hour: Column) -> Column:
    return F.concat_ws("/", event_type, date, hour)


def event_partition(df: DataFrame) -> DataFrame:
    """Add the bucket of each event: UTC ``date``, UTC ``hour`` and ``type/date/hour``."""
    ts = F.col("timestamp")
    date, hour = utc_date(ts), utc_hour(ts)
    return df.withColumns({"date": date, "hour": hour, "path": bucket_path(F.col("type"), date, hour)})


def select_properties(
    df: DataFrame, policies: Mapping[str, Iterable[str]] | Iterable[tuple[str, Iterable[str]]]
) -> DataFrame:
    """Keep only listed keys of top-level map nodes held as JSON text.

    ``policies`` pairs a node (column) with the keys to keep.  No keys means
    keep all, nodes without a policy stay as they are, and of several policies
    for one node the first one counts.  Values of kept keys keep their kind and
    digits; only the spacing within them may change.  A node that is no JSON
    object stays as it is.
    """
    pairs = policies.items() if isinstance(policies, Mapping) else policies
    first: dict[str, list[str]] = {}
    for node, keys in pairs:
        first.setdefault(node, list(keys))
    kept = {node: keep_keys(F.col(node), keys) for node, keys in first.items() if keys and node in df.columns}
    return df.withColumns(kept) if kept else df


def keep_keys(json: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    # As text every value but a string is written as it came; the variant tells strings.
    texts, kinds = F.from_json(json, "map<string,string>"), F.from_json(json, "map<string,variant>")

    def quoted(text: Column) -> Column:
        as_array = F.to_json(F.array(text))
        return F.substring(as_array, F.lit(2), F.length(as_array) - 2)

    def written(key: Column, value: Column) -> Column:
        is_text = F.schema_of_variant(F.element_at(kinds, key)) == "STRING"
        return F.concat(quoted(key), F.lit(":"), F.coalesce(F.when(is_text, quoted(value)).otherwise(value), F.lit("null")))

    kept = F.transform(F.map_entries(F.map_filter(texts, lambda k, _: k.isin(keys))), lambda e: written(e["key"], e["value"]))
    result = F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}"))
    return F.when(is_json_object(json), result).otherwise(json)


def canonical_json(json: Column) -> Column:
    """JSON text with sorted keys at every level, so equal payloads are equal strings.

    Text that is not JSON stands for itself.  Numbers compare by kind and value:
    ``1.0`` and ``1.00`` are the same, ``1`` is not, and no digit of a long
    integer is lost.
    """
    # Numbers of other kinds than a plain integer are wrapped, outside of strings.
    pieces = F.regexp_extract_all(json, F.lit(r'("(?:[^"\\]|\\.)*+"|[^"]++)'), 1)

    def marked(piece: Column) -> Column:
        decimal = F.regexp_replace(piece, r"(-?\d+\.\d+)(?![\d.eE])", "$1E0")
        wrapped = F.regexp_replace(decimal, r"(-?\d+(?:\.\d+)?[eE][+-]?\d+)", '{"float":$1}')
        wrapped = F.regexp_replace(wrapped, r"(?<![\d.eE+-])(-?\d{19,})(?![\d.eE])", '{"integer":"$1"}')
        return F.when(piece.startswith('"'), piece).otherwise(wrapped)

    as_marked = F.array_join(F.transform(pieces, marked), "")
    plain = F.try_parse_json(json)
    return F.when(plain.isNull(), json).otherwise(F.coalesce(F.to_json(F.try_parse_json(as_marked)), F.to_json(plain)))


def event_equal(left: str, right: str) -> Column:
    """Null-safe equality of two envelope structs: scalars as they are,
    timestamps by instant, payloads without regard to key order."""
    same = F.lit(True)
    for field in ENVELOPE_FIELDS:
        a, b = F.col(f"{left}.{field}"), F.col(f"{right}.{field}")
        if field == "data":
            a, b = canonical_json(a), canonical_json(b)
        same = same & a.eqNullSafe(b)
    return same


def event_line(payload: str = "data") -> Column:
    """An event as one JSON line.  The payload is JSON text and is spliced in
    unchanged, so numbers and key order survive; text that is none goes in as a
    string, and so cannot spoil the line."""
    head = F.to_json(
        F.struct(
            "type", "uuid", "host", F.date_format("timestamp", TIMESTAMP_FORMAT).alias("timestamp")
        ),
        {"ignoreNullFields": "false"},
    )
    as_array = F.to_json(F.array(payload))
    as_string = F.substring(as_array, F.lit(2), F.length(as_array) - 2)
    return F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"data":'),
        F.when(F.col(payload).isNull(), "null").when(one_json_value(F.col(payload)), F.col(payload)).otherwise(as_string),
        F.lit("}"),
    )


def one_json_value(line: Column) -> Column:
    """True when the text is exactly one JSON value.

    The JSON functions ignore what follows the first value, so the text is
    wrapped twice: text that closes the array early breaks the object, and the
    other way round.
    """
    as_array = F.json_array_length(F.concat(F.lit("["), line, F.lit("]")))
    as_object = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}")))
    return F.coalesce((as_array == 1) & as_object.isNotNull(), F.lit(False))
