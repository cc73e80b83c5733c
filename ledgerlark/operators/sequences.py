"""Dense numbers, sequences that go on, and pages of a sorted table, without a window over all rows.

Rows are dealt into ranges of the order and sorted within; the rows of the ranges before, a number for each range, are
what a range needs to number its own. A key with many rows is cut between ranges where the order goes on within it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.errors import EngineError
from ledgerlark.sources.tables import scratch

#: monotonically_increasing_id() has the partition above this bit and the row within it below.
_ROWS = 33


@dataclass(frozen=True)
class Ordered:
    """A sorted table in ranges. rows: the table with _part and _row, in one folder for each _part; before: how many rows
    the parts before have, by part; total: how many there are."""

    rows: DataFrame
    before: dict[int, int]
    total: int

    def numbered(self, column: str, last: int = 0) -> DataFrame:
        """The rows with a number each, from last + 1 on in their order, without a gap."""
        spark = self.rows.sparkSession
        first = spark.createDataFrame(list(self.before.items()), "_part int, _before long")  # a row for each range
        number = F.col("_before") + F.col("_row") + 1 + F.lit(last).cast("long")
        return self.rows.join(F.broadcast(first), "_part").select(*[c for c in self.rows.columns if c not in ("_part", "_row")], number.alias(column))

    def slice(self, offset: int, limit: int) -> DataFrame:
        """Rows offset + 1 to offset + limit of the order; only the ranges that have some of them are read."""
        ends = {p: b + n for (p, b), n in zip(self.before.items(), self._sizes(), strict=True)}
        parts = [p for p, b in self.before.items() if b < offset + limit and ends[p] > offset]
        number = F.create_map(*[x for p in parts for x in (F.lit(p), F.lit(self.before[p]))])[F.col("_part")] + F.col("_row") if parts else F.lit(-1)
        here = self.rows.where(F.col("_part").isin(parts) if parts else F.lit(False))
        return here.where((number >= offset) & (number < offset + limit)).drop("_part", "_row")

    def _sizes(self) -> list[int]:
        firsts = [*self.before.values(), self.total]
        return [b - a for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


def ordered(df: DataFrame, order: list[Column | str], ranges: int | None = None) -> Ordered:
    """df by the order, which should be total: rows that are equal in it come in any order. Written once to the scratch
    folder, so that all later reads see one order."""
    if {"_part", "_row"} & set(df.columns):
        raise EngineError("NAME_TAKEN", "_part and _row are names of the ranges", "df")
    spark = df.sparkSession
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    number = F.monotonically_increasing_id()
    placed = dealt.sortWithinPartitions(*order).withColumns({"_part": F.shiftright(number, _ROWS).cast("int"), "_row": number.bitwiseAND((1 << _ROWS) - 1)})
    path = scratch(spark)
    placed.write.partitionBy("_part").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n
    return Ordered(rows.select(*df.columns, "_part", "_row"), before, total)


def next_values(df: DataFrame, order: list[Column | str], column: str, last: int, ranges: int | None = None) -> tuple[DataFrame, int]:
    """df with the values of a sequence whose last value was last, by the order, and the sequence's new last value."""
    done = ordered(df, order, ranges)
    return done.numbered(column, last), last + done.total


def page(done: Ordered, number: int, limit: int) -> DataFrame:
    """A page of a sorted table, numbered from 1."""
    if number < 1 or not 1 <= limit <= 200:
        raise EngineError("INVALID_PAGE", "page is at least 1, limit from 1 to 200", "page")
    return done.slice((number - 1) * limit, limit)


def after(df: DataFrame, order: list[tuple[str, bool]], key: tuple, limit: int) -> DataFrame:
    """The rows that follow key in an order of columns (name, ascending) without nulls: the next page without counting
    those before. The condition reaches the scan, and only limit rows of each task leave it."""
    beyond, same = F.lit(False), F.lit(True)
    for (name, up), value in zip(order, key, strict=True):
        beyond = beyond | (same & (F.col(name) > F.lit(value) if up else F.col(name) < F.lit(value)))
        same = same & (F.col(name) == F.lit(value))
    return df.where(beyond).orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in order]).limit(limit)
