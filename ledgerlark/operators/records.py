"""Role-scoped, filtered, sorted, paged, counted and exported record sets.

All functions take and return lazy DataFrames; nothing is collected but the totals of page_of. Filters only narrow:
the role's predicate is always part of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.errors import EngineError

#: The column that a role's rows are told by; None: all rows.
ROLE_COLUMN = {"booth": "user_id", "constituency": "assembly_constituency_id", "district": "district_id", "mandal": "mandal_id", "superadmin": None}
#: Columns that a list can be sorted by.
SORTABLE = ("name", "epic", "serial_number", "part_number_and_name", "district_id", "assembly_constituency_id")
MAX_PAGE_SIZE, PAGE_SIZE = 200, 50
#: The header of an export and the column under it.
EXPORT = {
    "ID": "id", "Name": "name", "EPIC": "epic", "Mobile": "mobile", "Address": "address", "Serial Number": "serial_number", "Part": "part_number_and_name",
    "Constituency": "assembly_constituency_name", "District": "district", "State": "state",
}


def role_scope(records: DataFrame, role: str, owner, columns: Mapping[str, str | None] = ROLE_COLUMN) -> DataFrame:
    """The rows that a user of this role may see; owner: the user's own value of the role's column.

    A user without a value sees nothing, as a comparison with null does.
    """
    if role not in columns:
        raise EngineError("INVALID_ROLE", f"no such role: {role}", "role")
    column = columns[role]
    return records if column is None else records.where(F.col(column) == F.lit(owner))


def like_pattern(value: str) -> str:
    """%value% without outer white space; % and _ stay wildcards, and a backslash counts only before %, _ and itself."""
    kept = re.sub(r"\\(.|\Z)", lambda m: m[0] if m[1] and m[1] in "%_\\" else m[1], value.strip(), flags=re.S)
    return f"%{kept}%"


def contains(column: Column, value: str) -> Column:
    """Case-insensitive containment; a value of white space keeps every row that is not null."""
    return column.ilike(like_pattern(value))


def search(columns: list[Column], value: str) -> Column:
    return reduce(lambda a, b: a | b, [contains(c, value) for c in columns])


@dataclass(frozen=True)
class Filters:
    """Optional filters. Text filters are unset if None or ''; numbers if None (0 is a value)."""

    name: str | None = None
    epic: str | None = None
    mobile: str | None = None
    state: str | None = None
    part: str | None = None
    search: str | None = None
    district_id: int | None = None
    mandal_id: int | None = None
    assembly_constituency_id: int | None = None
    booth_id: int | None = None
    state_id: int | None = None
    state_code: str | None = None
    ac_number: int | None = None

    def applied(self) -> dict:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None and v != ""}


def apply_filters(records: DataFrame, wanted: Filters, constituencies: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """Every set filter narrows. State and constituency number are semi-joins, for records carry neither."""
    on = wanted.applied()
    text = {"name": "name", "epic": "epic", "mobile": "mobile", "state": "state", "part": "part_number_and_name"}
    exact = ("district_id", "mandal_id", "assembly_constituency_id", "booth_id")
    preds = [contains(F.col(c), on[k]) for k, c in text.items() if k in on] + [F.col(k) == F.lit(on[k]) for k in exact if k in on]
    if "search" in on:
        preds.append(search([F.col("name"), F.col("epic"), F.col("mobile")], on["search"]))
    out = reduce(DataFrame.where, preds, records)
    if "state_id" in on or "state_code" in on:
        inside = constituencies if "state_id" not in on else constituencies.where(F.col("state_id") == on["state_id"])
        if "state_code" in on:
            inside = inside.join(states.where(F.col("state_code") == F.lit(on["state_code"].strip())), "state_id", "left_semi")
        out = out.join(inside.select(F.col("id").alias("assembly_constituency_id")), "assembly_constituency_id", "left_semi")
    if "ac_number" in on:
        numbered = constituencies.where(F.col("ac_number") == on["ac_number"]).select(F.col("id").alias("assembly_constituency_id"))
        out = out.join(numbered, "assembly_constituency_id", "left_semi")
    return out.select(*records.columns)


def ordering(sort_by: str, sort_order: str, sortable=SORTABLE, key: str = "id") -> list[Column]:
    """Nulls last ascending and first descending; the key makes the order total."""
    if sort_by not in sortable:
        raise EngineError("INVALID_SORT_FIELD", f"allowed: {', '.join(sorted(sortable))}", "sort_by")
    if sort_order.lower() not in ("asc", "desc"):
        raise EngineError("INVALID_SORT_ORDER", "allowed: asc, desc", "sort_order")
    column = F.col(sort_by)
    return [column.desc_nulls_first() if sort_order.lower() == "desc" else column.asc_nulls_last(), F.col(key).asc_nulls_last()]


def page(records: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise EngineError("INVALID_INPUT", f"page >= 1 and 1 <= limit <= {MAX_PAGE_SIZE} are needed", "page")
    return records.orderBy(*order).offset((number - 1) * size).limit(size)


def page_meta(records: DataFrame, number: int, size: int) -> DataFrame:
    """One row: total, total_pages, page, is_last_page. No rows: 0 pages, and the page is the last."""
    total = records.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / F.lit(size)).cast("long")
    return total.select("total", pages.alias("total_pages"), F.lit(number).cast("long").alias("page"), (F.lit(number) >= pages).alias("is_last_page"))


def count(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"))


def serialise(records: DataFrame) -> DataFrame:
    """Ids as text; a null user_id stays null."""
    text = {"id", "user_id"}
    return records.select(*[F.col(c).cast("string").alias(c) if c in text else F.col(c) for c in records.columns])


def export(records: DataFrame) -> DataFrame:
    """The columns of an export under its header; the id as text."""
    return records.select(*[(F.col(c).cast("string") if c == "id" else F.col(c)).alias(h) for h, c in EXPORT.items()])


def numeric_order(*columns: str) -> list[Column]:
    """Text columns ordered by the numbers that they hold; what is no number comes last, as text."""
    return [x for c in columns for x in (F.col(c).try_cast("long").asc_nulls_last(), F.col(c).asc_nulls_last())]
