"""The three levels of places: searches, lookups and the ascent through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.errors import EngineError
from ledgerlark.operators.records import contains


def require(table: DataFrame, key: str, value, code: str) -> None:
    """Raises the code if no row has the key; a look at one row."""
    if table.where(F.col(key) == F.lit(value)).select(key).limit(1).isEmpty():
        raise EngineError(code, f"no {key} {value}", key)


def _matches(names: list[str], code: str | None, value: str | None) -> Column:
    if not value:
        return F.lit(True)
    hit = F.lit(False)
    for name in names:
        hit = hit | F.coalesce(contains(F.col(name), value), F.lit(False))
    return hit | F.coalesce(F.col(code) == F.lit(value.strip()), F.lit(False)) if code else hit


def states(table: DataFrame, search: str | None = None) -> DataFrame:
    found = table.where(_matches(["state_name_en", "state_name_hi"], "state_code", search))
    return found.select("state_id", "state_code", "state_name_en", "state_name_hi").orderBy("state_name_en", "state_id")


def districts(table: DataFrame, state_table: DataFrame, state_id: int | None = None, search: str | None = None) -> DataFrame:
    if state_id is not None:
        require(state_table, "state_id", state_id, "STATE_NOT_FOUND")
        table = table.where(F.col("state_id") == state_id)
    found = table.where(_matches(["district_name_en", "district_name_hi"], "lgd_district_code", search))
    # Both tables are reference data; Spark broadcasts the states if their size, which it knows, allows.
    joined = found.join(state_table.select("state_id", "state_code", "state_name_en"), "state_id", "left")
    return joined.select("district_id", "district_name_en", "district_name_hi", "lgd_district_code", F.col("mandala_id").alias("mandal_id"), "state_id", "state_code", "state_name_en").orderBy("district_name_en", "district_id")


def constituencies(table: DataFrame, state_table: DataFrame, district_table: DataFrame, state_id: int | None = None, district_id: int | None = None, ac_number: int | None = None, search: str | None = None) -> DataFrame:
    if state_id is not None:
        require(state_table, "state_id", state_id, "STATE_NOT_FOUND")
    if district_id is not None:
        require(district_table, "district_id", district_id, "DISTRICT_NOT_FOUND")
    for column, value in (("state_id", state_id), ("district_id", district_id), ("ac_number", ac_number)):
        if value is not None:
            table = table.where(F.col(column) == value)
    found = table.where(_matches(["constituency", "constituency_hindi"], None, search))
    joined = found.join(state_table.select("state_id", "state_code"), "state_id", "left").join(district_table.select("district_id", "district_name_en"), "district_id", "left")
    columns = [F.col(c) for c in ("id", "ac_number", "constituency", "constituency_hindi", "state_id", "state_code", "district_id", "lgd_district_code", "district", "district_name_en")]
    return joined.select(*columns, F.lit(None).cast("string").alias("reservation")).orderBy("ac_number", "id")


def candidates(rows: DataFrame, state_table: DataFrame, district_table: DataFrame) -> DataFrame:
    """Rows of the constituency table with what a choice between them needs: the names and codes of all three levels."""
    s = state_table.select("state_id", "state_code", "state_name_en")
    d = district_table.select("district_id", "district_name_en", "district_name_hi")
    columns = ("id", "state_id", "state_code", "state_name_en", "ac_number", "constituency", "constituency_hindi", "district_id", "district_name_en", "district_name_hi", "lgd_district_code")
    return rows.join(s, "state_id", "left").join(d, "district_id", "left").select(*columns)


def brief() -> Column:
    """The struct of a row of candidates() that an answer shows."""
    names = {"constituency_id": "id", "state_code": "state_code", "state_name_en": "state_name_en", "ac_number": "ac_number", "constituency": "constituency", "constituency_hindi": "constituency_hindi", "district_lgd_code": "lgd_district_code", "district_name_en": "district_name_en"}
    return F.struct(*[F.col(c).alias(n) for n, c in names.items()])


def bundle(levels: dict[str, DataFrame]) -> DataFrame:
    """level and rows of each level, as one table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("level"), "rows") for name, df in levels.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def ascend(users: DataFrame, booths: DataFrame, constituency_table: DataFrame, district_table: DataFrame) -> DataFrame:
    """Each user's own ids, completed from booth to constituency to district to mandal; a gap stays null."""
    b = booths.select(F.col("id").alias("booth_id"), F.col("constituency_id").alias("_c"), F.col("district_id").alias("_d"), F.col("mandal_id").alias("_m"))
    out = users.join(b, "booth_id", "left").withColumn("constituency_id", F.coalesce("constituency_id", "_c"))
    c = constituency_table.select(F.col("id").alias("constituency_id"), F.col("district_id").alias("_d2"))
    out = out.join(c, "constituency_id", "left").withColumn("district_id", F.coalesce("district_id", "_d2", "_d"))
    d = district_table.select("district_id", F.col("mandala_id").alias("_m2"))
    out = out.join(d, "district_id", "left").withColumn("mandal_id", F.coalesce("mandal_id", "_m2", "_m"))
    return out.select(*users.columns)
