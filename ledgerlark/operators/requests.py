"""Look-ups of single rows, and the checks that requests meet before anything is read or written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.records import ROLE_COLUMN
from ledgerlark.operators.resolve import RESOLVED

#: Shortest user name and password, digits of a mobile number.
USERNAME, PASSWORD, MOBILE = 5, 6, 10
#: The id that each role needs.
ROLE_ID = {"mandal": "mandal_id", "district": "district_id", "constituency": "constituency_id", "booth": "booth_id"}
#: Types of uploads and their greatest size.
UPLOAD_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/webp", "image/svg+xml", "image/heic", "image/heif"]
UPLOAD_BYTES = 10 * 1024 * 1024


def by_key(table: DataFrame, key: str, value) -> DataFrame:
    """The row with this key, or none."""
    return table.where(F.col(key) == F.lit(value)).limit(1)


def by_unique(users: DataFrame, column: str, value: str) -> DataFrame:
    """The user with this username (in lower case), email or mobile; nothing for no value."""
    return by_key(users, column, value.lower() if column == "username" else value) if value else users.limit(0)


def _blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"(?U)\s", ""), F.lit("")) == ""


def registration_issues() -> Column:
    """An array of what is wrong with each registration: an id of 0 counts as none."""
    username, password = F.coalesce("username", F.lit("")), F.coalesce("password", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    found = {
        "first_name is required": _blank(F.col("first_name")),
        "username is required": _blank(username),
        f"username has fewer than {USERNAME} characters": ~_blank(username) & (F.length(username) < USERNAME),
        "password is required": password == "",
        f"password has fewer than {PASSWORD} characters": (password != "") & (F.length(password) < PASSWORD),
        f"mobile has not {MOBILE} digits": (F.coalesce("mobile", F.lit("")) != "") & (F.length("mobile") != MOBILE),
        "role is unknown": ~role.isin(*ROLE_COLUMN),
    } | {f"{key} is required": (role == r) & (F.coalesce(F.col(key), F.lit(0)) == 0) for r, key in ROLE_ID.items()}
    return F.array_compact(F.array(*[F.when(p, F.lit(m)) for m, p in found.items()]))


def upload_issue(kind: Column, size: Column) -> Column:
    """What keeps a file from being taken; null if nothing does."""
    return F.when(~F.coalesce(kind.isin(UPLOAD_TYPES), F.lit(False)), F.lit("INVALID_FILE_TYPE")).when(size > UPLOAD_BYTES, F.lit("FILE_TOO_LARGE"))


def source_tag(code: Column, special: Mapping[str, str], default: str) -> Column:
    """The version of the source that holds for a state: of the special ones theirs, of all others the default."""
    out = F.lit(default)
    for key, tag in special.items():
        out = F.when(code == key, F.lit(tag)).otherwise(out)
    return out


def reply_fields(reply: Column, names: Mapping[str, str]) -> Column:
    """A struct of value and confidence for each field of a service's reply: 0.99 if it has a value, else none and 0."""
    value = {field: F.nullif(reply[source], F.lit("")) for field, source in names.items()}
    parts = [F.struct(v.alias("value"), F.when(v.isNotNull(), F.lit(0.99)).otherwise(F.lit(0.0)).alias("confidence")).alias(k) for k, v in value.items()]
    nothing = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence")).alias("district")
    return F.struct(*parts, nothing)


def names_only(resolutions: DataFrame, constituencies: DataFrame, districts: DataFrame) -> DataFrame:
    """req_id, constituency and district by their local names (the English one where there is none) for what is
    resolved, nulls for what is not."""
    c = constituencies.select(F.col("id").alias("match_id"), F.coalesce(F.nullif(F.col("constituency_hindi"), F.lit("")), "constituency").alias("constituency"), "district_id")
    d = districts.select("district_id", F.col("district_name_hi").alias("district"))
    found = resolutions.where(F.col("status") == RESOLVED).join(c, "match_id").join(d, "district_id", "left").select("req_id", "constituency", "district")
    return resolutions.select("req_id").join(found, "req_id", "left")
