"""Loads and changes as new tables: (old rows, changes) -> rows. Inputs are never written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import match_key


def _same(a: DataFrame, b: DataFrame, keys: list[str], null_safe: bool) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k].eqNullSafe(b[k]) if null_safe else a[k] == b[k])
    return out


def first_of_each(stage: DataFrame, keys: list[str], order: list[str] | None = None, null_safe: bool = True) -> DataFrame:
    """One row of each key: the first by order, or by all columns. Unless null_safe, rows with a null key all stay."""
    pick = F.min_by(F.struct(*stage.columns), F.struct(*order)) if order else F.min(F.struct(*stage.columns))
    # A null in a key makes a row's own number part of the key, so that it stays alone; one shuffle for all rows.
    alone = [] if null_safe else [F.when(F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull(), F.monotonically_increasing_id()).alias("_alone")]
    return stage.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], *alone).agg(pick.alias("r")).select("r.*")


def insert_absent(target: DataFrame, stage: DataFrame, keys: list[str], null_safe: bool = False, order: list[str] | None = None) -> DataFrame:
    """target and the rows of stage whose key it has not, one of each key: the first by order (or by all columns), as if
    they came one after the other. With null_safe, null is a key like any other; else a null key is never present."""
    once = first_of_each(stage, keys, order, null_safe)
    fresh = once.alias("s").join(target.select(*keys).alias("t"), _same(once, target, keys, null_safe), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def split_inserts(target: DataFrame, stage: DataFrame, keys: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of stage to insert, and those refused: duplicates of target's rows or of earlier ones of stage, nulls being
    equal."""
    once = first_of_each(stage, keys, order)
    new = once.join(target.select(*keys), _same(once, target, keys, True), "left_anti")
    return new, stage.exceptAll(new)


def update_present(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of changes that are not null replace those of the row with the same key; keys of changes are unique."""
    values = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = target.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in target.columns])


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """update_present, and the rows of changes with new keys (the first by all columns of each, all with a null key). One
    aggregate over both by the key: keys of target are unique, or null and then of no change."""
    missing = [c for c in target.columns if c not in changes.columns]
    given = changes.withColumns({c: F.lit(None).cast(target.schema[c].dataType) for c in missing}).select(*target.columns) if missing else changes.select(*target.columns)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    alone = F.when(~whole, F.monotonically_increasing_id()).alias("_alone")
    both = target.withColumn("_side", F.lit(0)).union(given.withColumn("_side", F.lit(1)))
    row = F.struct(*target.columns)
    sides = both.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], alone).agg(F.min(F.when(F.col("_side") == 0, row)).alias("o"), F.min(F.when(F.col("_side") == 1, row)).alias("n"))
    return sides.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c not in keys else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in target.columns])


def delete(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys), keys, "left_anti").select(*target.columns)


def enrich(voters: DataFrame, constituencies: DataFrame, districts: DataFrame) -> DataFrame:
    """Names and ids that a saved record takes from its constituency: the local name, or the English one if that is
    null or empty."""
    local = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    c = constituencies.select(F.col("id").alias("assembly_constituency_id"), local("constituency_hindi", "constituency").alias("_name"), F.col("district_id").alias("_district_id"))
    d = districts.select(F.col("district_id").alias("_district_id"), local("district_name_hi", "district_name_en").alias("_district"), F.col("mandala_id").alias("_mandal_id"))
    joined = voters.join(c, "assembly_constituency_id", "left").join(d, "_district_id", "left")
    taken = {"assembly_constituency_name": "_name", "district": "_district", "district_id": "_district_id", "mandal_id": "_mandal_id"}
    return joined.select(*[F.coalesce(taken[x], x).alias(x) if x in taken else F.col(x) for x in voters.columns])


def reconcile(rows: DataFrame, reference: DataFrame, on: tuple[str, str], ref: tuple[str, str], ref_code: str, aliases: DataFrame | None = None) -> DataFrame:
    """rows with code and confidence, by the state's code and the name's key, for one name is in several states.

    on, ref: the columns of state and name in rows and in reference. exact if just one reference row of the state has the
    key, mapped if an alias (state, key, code) gives it, needs_review otherwise, no_district_in_source if the name is
    null or blank.
    """
    keyed = reference.select(F.col(ref[0]).alias("_state"), match_key(F.col(ref[1])).alias("_key"), F.col(ref_code).cast("string").alias("_code"))
    unique = keyed.groupBy("_state", "_key").agg(F.max("_code").alias("_code"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    out = rows.withColumns({"_state": F.col(on[0]), "_key": match_key(F.col(on[1]))}).join(unique, ["_state", "_key"], "left")
    if aliases is not None:
        out = out.join(aliases.select(F.col("state").alias("_state"), F.col("key").alias("_key"), F.col("code").cast("string").alias("_alias")), ["_state", "_key"], "left")
    else:
        out = out.withColumn("_alias", F.lit(None).cast("string"))
    confidence = F.when(F.coalesce(F.col("_key"), F.lit("")) == "", "no_district_in_source").when(F.col("_code").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "mapped").otherwise("needs_review")
    return out.select(*rows.columns, F.when(confidence != "no_district_in_source", F.coalesce("_code", "_alias")).alias("code"), confidence.alias("confidence"))


def _only(codes: DataFrame) -> DataFrame:
    """(_ref, _code) of the names that have one row."""
    return codes.groupBy("_ref").agg(F.max("_code").alias("_code"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def official(legacy: DataFrame, reference: DataFrame, name: str, ref_name: str, ref_code: str, aliases: DataFrame) -> DataFrame:
    """legacy with code and used (how many of its rows have the code): that of the equal name, else that of the alias
    (alias, name). A name that the reference has more than once, or an alias with two names, gives no code. Each row is to
    have a code that no other has."""
    codes = _only(reference.select(F.col(ref_name).alias("_ref"), F.col(ref_code).alias("_code")))
    direct = legacy.join(codes, F.col(name) == F.col("_ref"), "left").drop("_ref")
    known = _only(aliases.join(codes, aliases["name"] == codes["_ref"]).select(F.col("alias").alias("_ref"), F.col("_code"))).withColumnRenamed("_code", "_by_alias")
    found = direct.join(known, F.col(name) == F.col("_ref"), "left").select(*legacy.columns, F.coalesce("_code", "_by_alias").alias("code"))
    n = found.where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("used"))
    return found.join(n, "code", "left").select(*legacy.columns, "code", F.coalesce("used", F.lit(0)).alias("used"))


def coded(rows: DataFrame, codes: DataFrame, code: str, carried: list[str]) -> DataFrame:
    """rows with what the code's row carries; a null code matches nothing, and text that goes with the code is null
    without it."""
    return rows.join(codes.select(F.col(code), *[F.col(c).alias(f"_of_{c}") for c in carried]), code, "left").select(*[F.col(c) for c in rows.columns if c not in carried], *[F.col(f"_of_{c}").alias(c) for c in carried])


def save(voters: DataFrame, stored: DataFrame, constituencies: DataFrame, districts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What saving records comes to: (rows to insert, refused rows with their code).

    Refused are records of no known constituency (INVALID_CONSTITUENCY), and those whose identity number is stored in
    their constituency already, or comes earlier by id in the batch (EPIC_ALREADY_EXISTS). A null or empty number is no
    duplicate. The others are enriched from their constituency.
    """
    known = constituencies.select(F.col("id").alias("assembly_constituency_id"))
    unknown = voters.join(known, "assembly_constituency_id", "left_anti").select(*voters.columns)
    rest = voters.join(known, "assembly_constituency_id", "left_semi").select(*voters.columns).withColumn("epic", F.nullif(F.col("epic"), F.lit("")))
    keys = ["epic", "assembly_constituency_id"]
    once = first_of_each(rest, keys, ["id"], null_safe=False)
    new = once.join(stored.select(*keys), keys, "left_anti").select(*voters.columns)
    refused = unknown.withColumn("code", F.lit("INVALID_CONSTITUENCY")).unionByName(rest.exceptAll(new).withColumn("code", F.lit("EPIC_ALREADY_EXISTS")))
    return enrich(new, constituencies, districts), refused
