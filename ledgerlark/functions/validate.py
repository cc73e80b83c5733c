"""Checks of a reply's eight fields, and the choice between two replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions.text import without_fences

#: The fields of a reply.
REPLY_FIELDS = ["voter_name", "epic_number", "address", "serial_number", "part_number_name", "constituency", "state", "mobile_number"]
BAD_JSON = "Invalid JSON"
#: The issues, in the order in which they are listed.
ISSUES = [
    "Address and part_number_name are identical",
    "EPIC number and serial number are identical",
    "EPIC number is suspiciously long",
    "Serial number contains suspicious text",
    "Mobile number has suspicious length",
    "Address may contain Part Number information",
]
#: Points of a filled field, of a valid reply, and of an issue; and of no reply.
FILLED, VALID, ISSUE, NO_REPLY = 10, 50, -10, -1000


def parse_reply(raw: Column) -> Column:
    """A struct of REPLY_FIELDS: texts trimmed, null as '', numbers as text; null if the reply is no JSON object."""
    cleaned = without_fences(raw)
    got = F.from_json(cleaned, ", ".join(f"{f} string" for f in REPLY_FIELDS))
    fields = F.struct(*[F.trim(F.coalesce(got[f], F.lit(""))).alias(f) for f in REPLY_FIELDS])
    return F.when(F.try_parse_json(F.nullif(cleaned, F.lit(""))).isNotNull(), fields)


def _norm(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"(?U)\s+", " ")


def issues(reply: Column, get=None) -> Column:
    """The issues of a reply as an array, empty for a good one."""
    get = get or (lambda f: reply[f])
    address, part, epic, serial, mobile = (_norm(get(f)) for f in ("address", "part_number_name", "epic_number", "serial_number", "mobile_number"))
    words = lambda c: F.size(F.split(c, " "))
    found = [
        (address != "") & (address == part),
        (epic != "") & (epic == serial),
        F.length(epic) > 30,
        (serial != "") & (words(serial) > 5),
        (mobile != "") & ~F.length(F.regexp_replace(mobile, r"[^0-9]", "")).isin(10, 11, 12, 13),
        (address != "") & (words(address) <= 4) & F.contains(address, F.lit("part")),
    ]
    return F.when(reply.isNull(), F.array(F.lit(BAD_JSON))).otherwise(F.array_compact(F.array(*[F.when(p, F.lit(m)) for p, m in zip(found, ISSUES, strict=True)])))


def score(reply: Column, found: Column) -> Column:
    filled = sum((F.when(F.coalesce(reply[f], F.lit("")) != "", F.lit(FILLED)).otherwise(F.lit(0)) for f in REPLY_FIELDS), F.lit(0))
    return F.when(found.isNull(), F.lit(NO_REPLY)).otherwise(filled + F.when(F.size(found) == 0, F.lit(VALID)).otherwise(F.lit(0)) + ISSUE * F.size(found))


def better(first: Column, second: Column) -> Column:
    """'second' only if its score is strictly greater."""
    return F.when(second > first, F.lit("second")).otherwise(F.lit("first"))


def after_retry(first: Column, retry: Column, retry_issues: Column) -> Column:
    """A valid retry, else any that could be parsed, else the first reply."""
    return F.coalesce(F.when(F.size(retry_issues) == 0, retry), retry, first)
