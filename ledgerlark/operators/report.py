"""The validation report of a constituency table, in twelve sections."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.text import match_key
from ledgerlark.operators import gates
from ledgerlark.sources.tables import written

CONFIDENCES = ("exact", "mapped", "needs_review", "no_district_in_source")
#: Fixed value: what an extent that names a district has as a word.
NAMES_DISTRICT = r"\b(?:district|District|DISTRICT)\b"


@dataclass(frozen=True)
class Known:
    """What is known beside the rows. expected: rows in all; scheduled: rows of each state by law; not_current: states whose
    rows are of another version; missing: states without rows, with how many are expected; without: states that have none by
    law; districts: how many there are; aliases: how many are listed; reasons: (state, key of a heading) -> why it has no
    district; absent: rows that are known to be missing -> why."""

    expected: int = 0
    scheduled: dict[str, int] = field(default_factory=dict)
    not_current: dict[str, str] = field(default_factory=dict)
    missing: dict[str, int] = field(default_factory=dict)
    without: frozenset[str] = frozenset()
    districts: int = 0
    aliases: int = 0
    reasons: dict[tuple[str, str], str] = field(default_factory=dict)
    absent: dict[str, str] = field(default_factory=dict)


def missing_runs(df: DataFrame, group: str, key: str) -> DataFrame:
    """Runs of whole numbers that are missing between the least and the greatest of each group: first and last."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy(key))
    steps = df.select(group, F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("before", before)
    return steps.where(F.col(key) - F.col("before") > 1).select(group, (F.col("before") + 1).alias("first"), (F.col(key) - 1).alias("last"))


def counts_descending(df: DataFrame, *keys: str) -> DataFrame:
    """n of each key, the most frequent first, then by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def _item(section: int, item: Column | str, value: Column, order: Column | None = None) -> list[Column]:
    text = F.lit(item) if isinstance(item, str) else item
    return [F.lit(section).alias("section"), (F.lit(0) if order is None else order).cast("long").alias("place"), text.alias("item"), value.cast("string").alias("value")]


def _table(literals: dict, df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(*k, v) if isinstance(k, tuple) else (k, v) for k, v in literals.items()], schema)


def constituency_report(rows: DataFrame, states: DataFrame, known: Known) -> DataFrame:
    """section, place, item and value of the report. rows: state_code, ac_number, constituency, constituency_hindi, heading,
    district_code, confidence, extent and reservation; states: state_code of all. Null and blank texts are missing; codes
    are text and are placed by number. The rows are read once for the sums of states, and once each for duplicates, gaps,
    headings, codes and reservations, of which only groups are kept."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    crossing = F.coalesce(F.col("extent").rlike(NAMES_DISTRICT), F.lit(False))
    longest = F.max(F.struct(F.length("constituency").alias("n"), F.col("constituency").alias("name")))
    per_confidence = [F.count_if(F.col("confidence") == c).alias(f"c_{c}") for c in CONFIDENCES]
    sums = [F.count(F.lit(1)).alias("n"), F.min("ac_number").alias("low"), F.max("ac_number").alias("high"), F.count_if(blank("constituency")).alias("blank"), F.count_if(~blank("constituency_hindi")).alias("local"), F.count_if(crossing).alias("crossing")]
    by_state = written(rows.groupBy("state_code").agg(*sums, longest.alias("longest"), *per_confidence))
    names = ["n", "blank", "local", "crossing", *[f"c_{c}" for c in CONFIDENCES]]
    total = written(by_state.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.max("longest").alias("longest")))
    number = F.col("state_code").cast("int")
    parts = [total.select(*_item(1, "rows", F.col("n"))), total.select(*_item(1, "expected", F.lit(known.expected))), total.select(*_item(1, "shortfall", F.lit(known.expected) - F.col("n")))]

    scheduled = _table(known.scheduled, rows, "state_code string, want long")
    status = F.when(F.col("want").isNull(), "not scheduled").when(F.col("n") == F.col("want"), "OK").otherwise("DIFFERS")
    parts.append(by_state.join(F.broadcast(scheduled), "state_code", "left").select(*_item(2, F.col("state_code"), F.concat_ws(", ", F.col("n").cast("string"), F.col("want").cast("string"), status), number)))  # scheduled: a row for each state

    again = written(gates.duplicates(rows.where("ac_number is not null"), ["state_code", "ac_number"]))
    parts += [again.agg(F.count(F.lit(1)).alias("k")).select(*_item(3, "duplicates", F.col("k"))), again.select(*_item(3, F.concat_ws("/", "state_code", F.col("ac_number").cast("string")), F.col("n"), number))]

    runs = missing_runs(rows, "state_code", "ac_number")
    parts.append(runs.select(*_item(4, F.concat(F.col("state_code"), F.lit(" missing")), F.concat_ws("..", "first", "last"), number * 1_000_000 + F.col("first"))))
    parts.append(by_state.where("low <> 1").select(*_item(4, F.concat(F.col("state_code"), F.lit(" numbers run")), F.concat_ws("..", "low", "high"), number)))

    parts += [total.select(*_item(5, "blank names", F.col("blank"))), total.select(*_item(5, "longest name", F.concat_ws(", ", F.col("longest.n").cast("string"), "longest.name")))]

    parts += [total.select(*_item(6, c, F.col(f"c_{c}"))) for c in CONFIDENCES]
    heads = written(rows.groupBy("state_code", "heading").agg(F.count_if(F.col("confidence").isin("exact", "mapped")).alias("found"), F.count_if(F.col("confidence") == "needs_review").alias("unmatched")))
    codes = rows.where(~blank("district_code")).select("state_code", "district_code").distinct().agg(F.count(F.lit(1)).alias("k"))
    parts += [heads.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("found") > 0).alias("f")).select(F.inline(F.array(F.struct(*_item(6, "headings", F.col("k"))), F.struct(*_item(6, "headings with a district", F.col("f"))))))]
    parts += [codes.select(*_item(6, "districts referred to", F.concat(F.col("k").cast("string"), F.lit(f" of {known.districts}")))), total.select(*_item(6, "aliases", F.lit(known.aliases)))]

    reasons = _table(known.reasons, rows, "state_code string, _key string, why string")
    open_ = heads.where("unmatched > 0").withColumn("_key", match_key(F.col("heading"))).join(F.broadcast(reasons), ["state_code", "_key"], "left")  # reasons: a written list
    parts.append(open_.select(*_item(7, F.concat_ws(" ", "state_code", "heading"), F.concat(F.col("unmatched").cast("string"), F.lit(", "), F.coalesce("why", F.lit("not reviewed"))), number)))

    parts += [total.select(*_item(8, "extents that name a district", F.col("crossing"))), by_state.where("crossing > 0").select(*_item(8, F.col("state_code"), F.col("crossing"), number))]
    parts.append(total.select(*_item(9, "local names", F.concat_ws(" of ", F.col("local").cast("string"), F.col("n").cast("string")))))

    covered = gates.coverage(states, rows, "state_code", known.not_current, known.missing, set(known.without))
    covered = written(covered)
    kinds = {"verified": F.col("status") == "VERIFIED", "unresolved": F.col("status").startswith("UNRESOLVED"), "without an assembly": F.col("status") == "N/A"}
    parts.append(covered.select(*_item(10, F.col("state_code"), F.concat_ws(", ", F.col("n").cast("string"), "status"), number)))
    parts.append(covered.agg(*[F.count_if(k).alias(n) for n, k in kinds.items()]).select(F.inline(F.array(*[F.struct(*_item(10, n, F.col(n))) for n in kinds]))))

    expected = {**known.absent, **{f"state {s}": f"all {n} rows" for s, n in known.missing.items()}}
    parts.append(_table(expected, rows, "item string, why string").select(*_item(11, F.col("item"), F.col("why"))))
    parts.append(rows.groupBy(F.coalesce(F.nullif(F.col("reservation"), F.lit("")), F.lit("(general)")).alias("r")).agg(F.count(F.lit(1)).alias("n")).select(*_item(12, F.col("r"), F.col("n"), (F.col("r") == "(general)").cast("int"))))
    return reduce(DataFrame.union, parts)


def write_report(report: DataFrame, path: str) -> None:
    """The report as lines of text in its order; a few lines for each state."""
    line = F.concat(F.lpad(F.col("section").cast("string"), 2, " "), F.lit("  "), F.col("item"), F.lit(": "), F.coalesce("value", F.lit("")))
    report.orderBy("section", "place", "item").select(line.alias("value")).write.text(path)
