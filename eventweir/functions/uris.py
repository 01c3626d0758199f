"""URI checks and the delivery-quality words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message parts of the URI audit.
INVALID_URIS = "Invalid URIs: "
INVALID_SYNTAX = "Invalid syntax: "
INVALID_SCHEME = "Invalid scheme: "
SEPARATOR = "; "
JOINER = ", "

# Delivery quality as written in announcements -> as stored.
QOS_WORDS = {"retry": "retry", "bestEffort": "best_effort"}


def uri_scheme(uri: Column) -> Column:
    return F.try_parse_url(uri, F.lit("PROTOCOL"))


def uri_parses(uri: Column) -> Column:
    """A URI parses when it has a scheme or, being relative, a (maybe empty) path."""
    path = F.try_parse_url(uri, F.lit("PATH"))
    return uri_scheme(uri).isNotNull() | path.isNotNull()


def valid_uri(uri: Column) -> Column:
    """The URI itself, or NULL when it does not parse."""
    return F.when(uri_parses(uri), uri)


def uri_problem(uri: Column, schemes: Iterable[str]) -> Column:
    """``syntax``, ``scheme`` or NULL.  No schemes means any scheme, even none;
    schemes compare without regard to case."""
    allowed = [s.lower() for s in schemes]
    problem = F.when(~uri_parses(uri), "syntax")
    if allowed:
        known = F.coalesce(F.lower(uri_scheme(uri)).isin(allowed), F.lit(False))
        problem = problem.when(~known, "scheme")
    return problem


def audit_uri_list(uris: Column, schemes: Iterable[str]) -> Column:
    """Audit one list of URIs: ``struct<ok, invalid_syntax, invalid_scheme, message>``."""
    schemes = list(schemes)

    def having(kind: str) -> Column:
        bad = F.filter(uris, lambda u: uri_problem(u, schemes) == kind)
        return F.array_sort(F.array_distinct(bad))

    return audit_result(having("syntax"), having("scheme"))


def audit_result(syntax: Column, scheme: Column) -> Column:
    """The audit verdict from two sorted lists of offending URIs."""
    ok = (F.size(syntax) == 0) & (F.size(scheme) == 0)
    parts = F.concat_ws(
        SEPARATOR,
        F.when(F.size(syntax) > 0, F.concat(F.lit(INVALID_SYNTAX), F.array_join(syntax, JOINER))),
        F.when(F.size(scheme) > 0, F.concat(F.lit(INVALID_SCHEME), F.array_join(scheme, JOINER))),
    )
    return F.struct(
        ok.alias("ok"),
        syntax.alias("invalid_syntax"),
        scheme.alias("invalid_scheme"),
        F.when(~ok, F.concat(F.lit(INVALID_URIS), parts)).alias("message"),
    )


def parse_qos(word: Column) -> Column:
    """Stored form of a delivery quality; NULL means best effort, an unknown word is an error."""
    parsed = F.when(word.isNull(), F.lit(QOS_WORDS["bestEffort"]))
    for written, stored in QOS_WORDS.items():
        parsed = parsed.when(word == written, F.lit(stored))
    return parsed.otherwise(F.raise_error(F.concat(F.lit("unknown delivery quality: "), word)))
