"""A log of events checked by a finite automaton: which steps were legal, and the state at any time.

A step that the automaton does not allow is refused and changes nothing, so a state depends on all steps before. What a
run of steps does is a map from states to states, and maps of runs compose. The log is cut into runs of CHUNK steps of its
order by job and time; a run's map is folded within it, the states at the runs' starts follow from the maps, and each run
is then folded once more from its start. So the log of one job may be as long as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.sequences import ordered
from ledgerlark.sources.tables import written

CHUNK = 256
#: What a job can be; the first one is before any event.
STATES = ("none", "pending", "processing", "completed", "failed")
#: Steps that are legal.
LEGAL = {("none", "pending"), ("pending", "processing"), ("processing", "completed"), ("processing", "failed"), ("failed", "pending")}


def _next(states: tuple[str, ...], legal: set[tuple[str, str]]) -> Column:
    """The state after a step, at place state * number of states + step; a step that is none is refused."""
    return F.array(*[F.lit(j if (a, b) in legal else i) for i, a in enumerate(states) for j, b in enumerate(states)])


def checked(log: DataFrame, job: str, at: str, tie: str, status: str, states: tuple[str, ...] = STATES, legal: set[tuple[str, str]] = LEGAL, ranges: int | None = None) -> DataFrame:
    """The log with before, after and legal of each step, in the order of at (nulls first) and tie.

    A null or unknown status is never legal. Rows without a job are left out, for they are steps of nothing. Steps that
    are equal in at and tie come in any order.
    """
    n, table = len(states), _next(states, legal)
    code = F.coalesce(*[F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(states)], F.lit(-1))
    rows = ordered(log.where(F.col(job).isNotNull()).withColumn("_step", code), [F.col(job), F.col(at).asc_nulls_first(), F.col(tie)], ranges).numbered("_no", -1)
    rows = rows.withColumn("_chunk", F.floor(F.col("_no") / CHUNK))
    after = lambda state, step: F.when(step < 0, state).otherwise(F.get(table, state * n + step))
    chunks = written(rows.groupBy(job, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_no", "_step"))).alias("_steps")))  # at most CHUNK steps
    start = F.array(*[F.lit(i) for i in range(n)])
    maps = chunks.select(job, "_chunk", F.aggregate("_steps", start, lambda m, e: F.transform(m, lambda s: after(s, e["_step"]))).alias("map"))
    # A job's runs in order: the state at the start of each is where the maps before have led. One number for CHUNK steps.
    runs = maps.groupBy(job).agg(F.array_sort(F.collect_list(F.struct("_chunk", "map"))).alias("runs"))
    step = lambda acc, r: F.struct(F.get(r["map"], acc["s"]).alias("s"), F.concat(acc["all"], F.array(acc["s"])).alias("all"))
    led = F.aggregate("runs", F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("all")), step)["all"]
    starts = runs.select(job, F.explode(F.arrays_zip(F.col("runs")["_chunk"].alias("_chunk"), led.alias("_from"))).alias("r")).select(job, "r._chunk", "r._from")
    fold = lambda acc, e: F.concat(acc, F.array(after(F.element_at(acc, -1), e["_step"])))
    each = chunks.join(starts, [job, "_chunk"]).select(F.col("_steps")["_no"].alias("_no"), F.aggregate("_steps", F.array("_from"), fold).alias("_states"))
    found = each.select(F.posexplode("_no").alias("i", "_no"), "_states").select("_no", F.get("_states", F.col("i")).alias("_b"), F.get("_states", F.col("i") + 1).alias("_a"))
    name = lambda c: F.get(F.array(*[F.lit(s) for s in states]), c)
    allowed = F.coalesce(F.array_contains(F.array(*[F.lit(states.index(a) * n + states.index(b)) for a, b in sorted(legal)]), F.col("_b") * n + F.col("_step")) & (F.col("_step") >= 0), F.lit(False))
    return rows.join(found, "_no").select(*log.columns, name(F.col("_b")).alias("before"), name(F.col("_a")).alias("after"), allowed.alias("legal"))


def state_at(steps: DataFrame, job: str, at: str, tie: str, time: Column) -> DataFrame:
    """Each job's state at a time, from checked steps: that after its last step until then."""
    return steps.where(F.col(at) <= time).groupBy(job).agg(F.max_by("after", F.struct(at, tie)).alias("state"))
