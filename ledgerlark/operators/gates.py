"""Data-quality gates: each gives rows to look at or one row (check, got, want, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.errors import EngineError


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(child: DataFrame, parent: DataFrame, on: str, to: str) -> DataFrame:
    """Rows of child whose key is not null and not in parent."""
    return child.where(F.col(on).isNotNull()).join(parent.select(F.col(to).alias(on)), on, "left_anti").select(*child.columns)


def valid_references(child: DataFrame, parent: DataFrame, on: str, to: str) -> DataFrame:
    return child.join(parent.select(F.col(to).alias(on)).distinct(), on, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def disagreements(left: DataFrame, right: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """Pairs with equal keys for which the condition says that they disagree."""
    return left.join(right, on).where(condition)


def gaps(df: DataFrame, key: str) -> DataFrame:
    """Runs of integers between the least and the greatest key that are missing: first, last and size. Repeated and
    null keys do not matter. One sort of the distinct keys in ranges; a run is a row, however long it is."""
    keys = df.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    # Keys are dealt into blocks, and blocks into spans, of a fixed width; each block gets the greatest key before it. Only
    # the spans, a row for every 2^32 keys, are ordered as a whole.
    width = 1 << 16
    blocked = keys.withColumn("b", F.floor(F.col("k") / width))
    ends = blocked.groupBy("b").agg(F.max("k").alias("top")).withColumn("span", F.floor(F.col("b") / width))
    spans = ends.groupBy("span").agg(F.max("top").alias("top")).select("span", F.lag("top").over(Window.orderBy("span")).alias("span_before"))
    within = F.lag("top").over(Window.partitionBy("span").orderBy("b"))
    before = ends.withColumn("w", within).join(spans, "span").select("b", F.coalesce("w", "span_before").alias("last_before"))
    inner = F.lag("k").over(Window.partitionBy("b").orderBy("k"))
    steps = blocked.withColumn("prev", inner).join(before, "b").withColumn("prev", F.coalesce("prev", "last_before"))
    return steps.where("k - prev > 1").select((F.col("prev") + 1).alias("gap_first"), (F.col("k") - 1).alias("gap_last"), (F.col("k") - F.col("prev") - 1).alias("gap_size"))


def expected_counts(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """expected (key, want) with n of each key in actual (0 if absent) and whether they are equal."""
    n = actual.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return expected.join(n, key, "left").select(key, "want", F.coalesce("n", F.lit(0)).alias("n")).withColumn("passed", F.col("n") == F.col("want"))


def coverage(states: DataFrame, rows: DataFrame, key: str, not_current: dict[str, str], missing: dict[str, int], without: set[str]) -> DataFrame:
    """Every state's code with how many rows it has and a status: verified, unresolved (by its version, or as many are
    expected), n/a if it has none by law, unexpected if nothing explains that there are none."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    code = F.col(key)
    one_of = lambda values: code.isin(*values) if values else F.lit(False)
    text = lambda pairs, make: reduce(lambda done, kv: F.when(code == kv[0], F.lit(make(kv[1]))).otherwise(done), pairs.items(), F.lit(None).cast("string"))
    has = F.coalesce("n", F.lit(0)) > 0
    status = (
        F.when(has & one_of(not_current), text(not_current, lambda tag: f"UNRESOLVED ({tag})")).when(has, F.lit("VERIFIED"))
        .when(one_of(missing), text(missing, lambda want: f"UNRESOLVED ({want} expected)")).when(one_of(without), F.lit("N/A")).otherwise(F.lit("UNEXPECTED"))
    )
    return states.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def outside(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose value is not between low and high; null is no value."""
    return df.where(~F.col(column).between(low, high))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and n, how many rows have no value in it, for each of the columns, 0 too; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("s")).select("s.*")


def missing_targets(aliases: DataFrame, reference: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Aliases whose target is not in the reference; keys: column of aliases -> column of reference."""
    return aliases.join(reference.select(*[F.col(r).alias(a) for a, r in keys.items()]), list(keys), "left_anti").select(*aliases.columns)


def partition(df: DataFrame, column: str, excluded: list) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that the list excludes; a null is excluded by nothing."""
    out = F.coalesce(F.col(column).isin(*excluded), F.lit(False)) if excluded else F.lit(False)
    return df.where(~out), df.where(out)


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """counter, value (as text) and n, for each value of each of the columns; one pass."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*")
    return each.groupBy("counter", "value").agg(F.count(F.lit(1)).alias("n"))


def text_counts(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row: rows, blank ones (null, empty or white space), and those that match the pattern."""
    c = F.col(column)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias("n_blank"), F.count_if(c.rlike(pattern)).alias("n_matching"))


def distinct_pairs(df: DataFrame, columns: list[str], condition: Column) -> DataFrame:
    """One row: distinct values of the columns together, and those of the rows that meet the condition."""
    pair = F.struct(*columns)
    return df.agg(F.countDistinct(pair).alias("n_all"), F.countDistinct(F.when(condition, pair)).alias("n_meeting"))


def snapshot_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more: side is before or after."""
    columns = before.columns
    gone, new = before.exceptAll(after.select(*columns)), after.select(*columns).exceptAll(before)
    return gone.withColumn("side", F.lit("before")).union(new.withColumn("side", F.lit("after")))


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of after whose key is in before with another value in some column."""
    others = [c for c in before.columns if c not in keys]
    old = before.select(*keys, *[F.col(c).alias(f"old_{c}") for c in others])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in others], F.lit(False))
    return after.join(old, keys).where(differs).select(*after.columns, *[f"old_{c}" for c in others])


def children_per_parent(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Every parent with the number of its children, 0 too. Children are counted before the join."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return parents.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def longest(df: DataFrame, group: list[str], text: str, tie: str) -> DataFrame:
    """The longest text of each group; of several the one with the least tie."""
    return df.groupBy(*group).agg(F.max_by(F.struct(text, tie), F.struct(F.length(text), -F.col(tie))).alias("m")).select(*group, f"m.{text}", f"m.{tie}")


def mode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most common value of each group with n; of several the least."""
    n = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value))).alias("best")
    return n.groupBy(*group).agg(best).select(*group, F.col(f"best.{value}").alias(value), (-F.col("best.m")).alias("n"))


def bijection(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: pairs, distinct lefts and rights, and whether each has just one partner."""
    pairs = df.select(left, right).distinct()
    out = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct(left).alias("n_left"), F.countDistinct(right).alias("n_right"))
    return out.withColumn("passed", (F.col("n_pairs") == F.col("n_left")) & (F.col("n_pairs") == F.col("n_right")))


def check(label: str, got: DataFrame, want: int) -> DataFrame:
    """got: one row with one number."""
    value = F.col(got.columns[0]).cast("long")
    return got.select(F.lit(label).alias("check"), value.alias("got"), F.lit(want).cast("long").alias("want"), value.eqNullSafe(F.lit(want)).alias("passed"))


def enforce(checks: list[DataFrame]) -> DataFrame:
    """All checks as one table; raises if one has failed."""
    table = reduce(DataFrame.union, checks)
    failed = table.where(~F.col("passed")).orderBy("check").limit(20).collect()
    if failed:
        raise EngineError("GATE_FAILED", "; ".join(f"{r['check']}: got {r['got']}, want {r['want']}" for r in failed))
    return table


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """section, item and value (as text): a table of each section's first column as item and its others as one text."""
    parts = []
    for name, df in sections.items():
        item, *values = [F.col(c).cast("string") for c in df.columns]
        parts.append(df.select(F.lit(name).alias("section"), F.coalesce(item, F.lit("")).alias("item"), F.concat_ws(", ", *values).alias("value")))
    return reduce(DataFrame.union, parts)
