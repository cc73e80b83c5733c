"""Declared constraints of tables, compiled into as few scans as they need.

What a constraint asks of each row alone (not null, range, pattern, allowed values) and the row count are columns of one
aggregate for each table. Uniqueness is counted from one aggregate for each set of keys, and a reference from one
pre-aggregated join: keys of the child are counted first, so a hot key is one row of it. The catalogue lists what is
declared, and which tables and keys each constraint reads.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.errors import EngineError


@dataclass(frozen=True)
class Constraint:
    """kind: not_null, range, one_of, matches, unique, reference, rows. where: only rows for which it holds are asked, as
    by a partial index; it is SQL."""

    table: str
    kind: str
    columns: tuple[str, ...] = ()
    low: object = None
    high: object = None
    values: tuple = ()
    pattern: str = ""
    parent: str = ""
    parent_columns: tuple[str, ...] = ()
    where: str = ""

    @property
    def name(self) -> str:
        detail = {"range": f"{self.low}..{self.high}", "one_of": "|".join(map(str, self.values)), "matches": self.pattern, "reference": f"{self.parent}.{','.join(self.parent_columns)}", "rows": f"{self.low}..{self.high}"}.get(self.kind, "")
        return " ".join(x for x in (f"{self.table}.{','.join(self.columns)}".rstrip("."), self.kind, detail, f"where {self.where}" if self.where else "") if x)


def not_null(table: str, *columns: str, where: str = "") -> list[Constraint]:
    return [Constraint(table, "not_null", (c,), where=where) for c in columns]


def in_range(table: str, column: str, low=None, high=None, where: str = "") -> list[Constraint]:
    return [Constraint(table, "range", (column,), low, high, where=where)]


def one_of(table: str, column: str, *values, where: str = "") -> list[Constraint]:
    return [Constraint(table, "one_of", (column,), values=values, where=where)]


def matches(table: str, column: str, pattern: str, where: str = "") -> list[Constraint]:
    return [Constraint(table, "matches", (column,), pattern=pattern, where=where)]


def unique(table: str, *columns: str, where: str = "") -> list[Constraint]:
    """Rows with a null in a column are never equal to others."""
    return [Constraint(table, "unique", columns, where=where)]


def reference(table: str, columns: str | tuple[str, ...], parent: str, parent_columns: str | tuple[str, ...], where: str = "") -> list[Constraint]:
    """Rows with a null in a column refer to nothing and are not asked."""
    tuples = [c if isinstance(c, tuple) else (c,) for c in (columns, parent_columns)]
    return [Constraint(table, "reference", tuples[0], parent=parent, parent_columns=tuples[1], where=where)]


def row_count(table: str, low: int | None = None, high: int | None = None) -> list[Constraint]:
    return [Constraint(table, "rows", (), low, high)]


def of_schema(table: str, schema: StructType) -> list[Constraint]:
    """The constraints that a schema declares: columns that are not nullable."""
    return not_null(table, *[f.name for f in schema if not f.nullable])


def catalogue(declared: list[Constraint]) -> list[tuple[str, str, str, str, str]]:
    """(name, table, kind, columns, parent) of each constraint, as a database lists its own."""
    return sorted((c.name, c.table, c.kind, ",".join(c.columns), c.parent) for c in declared)


def _asked(c: Constraint) -> Column:
    return F.coalesce(F.expr(c.where), F.lit(False)) if c.where else F.lit(True)


def _broken(c: Constraint) -> Column:
    """Whether one row breaks the constraint; null breaks not_null alone."""
    x = F.col(c.columns[0])
    if c.kind == "not_null":
        bad = x.isNull()
    elif c.kind == "range":
        ends = [x < F.lit(c.low)] if c.low is not None else []
        ends += [x > F.lit(c.high)] if c.high is not None else []
        bad = reduce(lambda a, b: a | b, ends, F.lit(False))
    elif c.kind == "one_of":
        bad = ~x.isin(*c.values)
    else:
        bad = ~x.rlike(c.pattern)
    return _asked(c) & F.coalesce(bad, F.lit(False))


ROW_KINDS = ("not_null", "range", "one_of", "matches", "rows")


def _row_counts(df: DataFrame, own: list[Constraint]) -> DataFrame:
    """got of all constraints on the rows of one table: one scan, one row, unpivoted."""
    sums = [F.count(F.lit(1)).alias(f"c{i}") if c.kind == "rows" else F.count_if(_broken(c)).alias(f"c{i}") for i, c in enumerate(own)]
    pairs = F.array(*[F.struct(F.lit(c.name).alias("name"), F.col(f"c{i}").alias("got")) for i, c in enumerate(own)])
    return df.agg(*sums).select(F.explode(pairs).alias("s")).select("s.*")


def _repeats(df: DataFrame, keys: tuple[str, ...], own: list[Constraint]) -> DataFrame:
    """got of the uniqueness constraints on one set of keys: rows beyond the first of each key."""
    whole = df.dropna(subset=list(keys))
    counts = whole.groupBy(*keys).agg(*[F.count_if(_asked(c)).alias(f"c{i}") for i, c in enumerate(own)])
    sums = counts.agg(*[F.coalesce(F.sum(F.greatest(F.col(f"c{i}") - 1, F.lit(0))), F.lit(0)).alias(f"c{i}") for i in range(len(own))])
    pairs = F.array(*[F.struct(F.lit(c.name).alias("name"), F.col(f"c{i}").alias("got")) for i, c in enumerate(own)])
    return sums.select(F.explode(pairs).alias("s")).select("s.*")


def _dangling(child: DataFrame, parent: DataFrame, own: list[Constraint]) -> DataFrame:
    """got of the references from one set of columns to one set of parent columns: rows whose key the parent has not."""
    c = own[0]
    counts = child.dropna(subset=list(c.columns)).groupBy(*c.columns).agg(*[F.count_if(_asked(x)).alias(f"c{i}") for i, x in enumerate(own)])
    known = parent.select(*[F.col(p).alias(k) for k, p in zip(c.columns, c.parent_columns, strict=True)])
    missing = counts.join(known, list(c.columns), "left_anti")
    sums = missing.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(own))])
    pairs = F.array(*[F.struct(F.lit(x.name).alias("name"), F.col(f"c{i}").alias("got")) for i, x in enumerate(own)])
    return sums.select(F.explode(pairs).alias("s")).select("s.*")


def evaluate(tables: dict[str, DataFrame], declared: list[Constraint]) -> DataFrame:
    """name, kind, got (how many rows break the constraint; of kind rows, how many there are) and passed, for each."""
    if unknown := {x for c in declared for x in (c.table, c.parent) if x} - set(tables):
        raise EngineError("NO_TABLE", f"constraints name {', '.join(sorted(unknown))}", "tables")
    groups: dict[tuple, list[Constraint]] = defaultdict(list)
    for c in dict.fromkeys(declared):
        what = ("row", c.table) if c.kind in ROW_KINDS else ("unique", c.table, c.columns) if c.kind == "unique" else ("reference", c.table, c.columns, c.parent, c.parent_columns)
        groups[what].append(c)
    parts = []
    for what, own in groups.items():
        df = tables[own[0].table]
        parts.append(_row_counts(df, own) if what[0] == "row" else _repeats(df, what[2], own) if what[0] == "unique" else _dangling(df, tables[own[0].parent], own))
    if not parts:
        raise EngineError("NOTHING_DECLARED", "there are no constraints", "declared")
    got = reduce(DataFrame.unionByName, parts)
    low = F.coalesce(*[F.when(F.col("name") == c.name, F.lit(c.low if c.kind == "rows" and c.low is not None else 0)) for c in declared]).cast("long")
    high = F.coalesce(*[F.when(F.col("name") == c.name, F.lit((1 << 62) if c.high is None else c.high)) if c.kind == "rows" else F.when(F.col("name") == c.name, F.lit(0)) for c in declared]).cast("long")
    kind = F.coalesce(*[F.when(F.col("name") == c.name, F.lit(c.kind)) for c in declared])
    return got.select("name", kind.alias("kind"), "got", F.col("got").between(low, high).alias("passed"))


def breaking(tables: dict[str, DataFrame], c: Constraint) -> DataFrame:
    """The rows that break a constraint (of unique, all rows of a key that is there more than once)."""
    df = tables[c.table]
    if c.kind in ROW_KINDS:
        return df.where(_broken(c)) if c.kind != "rows" else df.limit(0)
    asked = df.where(_asked(c)).dropna(subset=list(c.columns))
    if c.kind == "unique":
        again = asked.groupBy(*c.columns).count().where("count > 1").select(*c.columns)
        return asked.join(again, list(c.columns), "left_semi").select(*df.columns)
    known = tables[c.parent].select(*[F.col(p).alias(k) for k, p in zip(c.columns, c.parent_columns, strict=True)])
    return asked.join(known, list(c.columns), "left_anti").select(*df.columns)


def enforce(tables: dict[str, DataFrame], declared: list[Constraint]) -> DataFrame:
    """evaluate(), as a small table; raises if a constraint does not hold. A row for each constraint comes to the driver."""
    outcome = evaluate(tables, declared)
    rows = outcome.orderBy("name").collect()
    if failed := [r for r in rows if not r["passed"]]:
        raise EngineError("CONSTRAINT", "; ".join(f"{r['name']}: {r['got']}" for r in failed[:20]))
    return outcome.sparkSession.createDataFrame(rows, outcome.schema)
