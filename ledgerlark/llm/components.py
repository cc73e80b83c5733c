"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import discard, settle


def _least(e: DataFrame) -> DataFrame:
    """The least neighbour of each node that has a smaller one."""
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _large(e: DataFrame, low: DataFrame) -> DataFrame:
    """Each node's greater neighbours go to the least of it and its neighbours. Centres of stars keep theirs, and low is
    a written table, so that a centre with very many neighbours can be split in the join."""
    return e.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    low = _least(e)
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge but the component's smallest, which names it.

    Loops and edges with a null end are ignored. Each round is written to the shared folder; the number of rounds
    is logarithmic in the number of nodes, and 2 where the edges are stars already.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b))
    now, seen = settle(e.distinct()), None
    while True:
        count, total = now.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("u", "v"), 20)), F.lit(0))).first()
        if count == 0 or (count, total) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = (count, total)
        low = settle(_least(now))
        after = settle(_small(_large(now, low)))
        discard(now)
        discard(low)
        now = after
