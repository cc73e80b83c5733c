"""SimHash fingerprints in Spark SQL, and the search for all fingerprints within a Hamming radius.

Terms are pairs of successive lower-cased words (the last word stands alone). Each occurrence votes with its
weight for the set bits of the term's 64-bit hash and against the others; a fingerprint bit is set where the
votes for it are more than half of all. The votes of a block of terms are counted in 16 longs of four 16-bit
lanes each, so that one masked shift adds four bits at a time; the sums are plain SQL aggregates.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import SPACE_CLASS, keyed_text, settle, table

BITS, LANES = 64, 16
LANE_MASK = 0x0001000100010001
#: A term weighs HEAVY if its first word has more than SHORT characters, else 1.
HEAVY, SHORT = 3, 3
#: Terms in a block: BLOCK * HEAVY votes fit into 15 bits, so that the highest lane stays positive.
BLOCK = 10_000
#: Rows of one ordered bucket, and how many buckets there are at most (a square, for the two-step lookup).
BUCKET_ROWS, BUCKETS_SIDE = 4_000, 128
#: Bits by which near fingerprints differ at most.
RADIUS = 3


def fingerprint_rows(rows: DataFrame, texts: list[str]) -> DataFrame:
    """The other columns of the rows and, for the i-th text column, its fingerprint as the long fp_<i>.

    Terms are exploded and their lanes summed where they arise (one row per text and block goes to the shuffle, not
    one per term). A null, empty or blank text has no terms and fingerprint 0. Repeated rows stay apart.
    """
    kept = [c for c in rows.columns if c not in texts]
    each = rows.withColumn("_row", F.monotonically_increasing_id())
    each = each.select("_row", *kept, F.posexplode(F.array(*texts)).alias("_text", "text"))
    words = each.select("_row", *kept, "_text", F.split(F.trim(F.lower(F.coalesce("text", F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), f"{SPACE_CLASS}+").alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))
    terms = words.select("_row", *kept, "_text", F.posexplode(pairs).alias("pos", "t"))
    blank = F.col("t.a") == ""
    terms = terms.select("_row", *kept, "_text", F.floor(F.col("pos") / BLOCK).cast("int").alias("_block"), F.xxhash64("t.a", "t.b").alias("h"), F.when(blank, F.lit(0)).when(F.length("t.a") > SHORT, F.lit(HEAVY)).otherwise(F.lit(1)).cast("long").alias("w"))
    lanes = [(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANE_MASK)) * F.col("w")) for i in range(LANES)]
    votes = terms.groupBy("_row", *kept, "_text", "_block").agg(*[F.sum(x).alias(f"l{i}") for i, x in enumerate(lanes)], F.sum("w").alias("all"))
    unpacked = [F.sum(F.shiftrightunsigned(f"l{bit % LANES}", 16 * (bit // LANES)).bitwiseAND(F.lit(0xFFFF))).alias(f"v{bit}") for bit in range(BITS)]
    whole = votes.groupBy("_row", *kept, "_text").agg(*unpacked, F.sum("all").alias("all"))
    fp = F.lit(0).cast("long")
    for bit in range(BITS):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"v{bit}") > F.col("all"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    one = whole.select("_row", *kept, "_text", fp.alias("fp"))
    return one.groupBy("_row", *kept).agg(*[F.max(F.when(F.col("_text") == i, F.col("fp"))).alias(f"fp_{i}") for i in range(len(texts))]).drop("_row")


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<c> for the given columns of the next row in descending doc_id; the last row's next is the first.

    A null doc_id comes last; equal ids are ordered by the column `order`, or else by the text's hash; in the result `order`
    is the place that a row then has, so that a second look at the same rows finds the same neighbours. Rows are dealt out to buckets of about
    BUCKET_ROWS by quantiles of the id, and each bucket also gets the first row of the one after it: one shuffle,
    no bucket that all rows meet in. Only the bounds of the buckets reach the driver.
    """
    keyed = docs.withColumn("_k", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("_h", F.col("order") if "order" in docs.columns else F.xxhash64("text"))
    ids = keyed.select("_k")
    side = BUCKETS_SIDE
    n = ids.count()
    buckets = max(1, min(side * side, n // BUCKET_ROWS))
    cuts: list[int] = []
    if buckets > 1:
        got = ids.agg(F.percentile_approx("_k", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q")).first()["q"]
        cuts = sorted(set(got))
    if cuts:
        groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
        coarse = F.array(*[F.lit(g[0]) for g in groups])
        fine = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
        at = F.size(F.filter(coarse, lambda c: c < F.col("_k")))
        within = F.size(F.filter(F.element_at(fine, F.greatest(at, F.lit(1))), lambda c: c < F.col("_k")))
        keyed = keyed.withColumn("_b", F.when(at == 0, F.lit(0)).otherwise((at - 1) * side + within).cast("int"))
    else:
        keyed = keyed.withColumn("_b", F.lit(0))
    heads = sorted((r["_b"], r["k"]) for r in keyed.groupBy("_b").agg(F.max("_k").alias("k")).collect())
    if not heads:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns}).withColumn("order", F.lit(0).cast("long"))
    # The head of bucket b ends the next higher bucket; the highest head ends the lowest bucket.
    ends = [(heads[(i + 1) % len(heads)][0], b, k) for i, (b, k) in enumerate(heads)]
    spark = docs.sparkSession
    lookup = spark.createDataFrame(ends, "_to int, _hb int, _hk long")
    first = keyed.join(F.broadcast(lookup), (keyed["_b"] == lookup["_hb"]) & (keyed["_k"] == lookup["_hk"]))  # a bound and three numbers per bucket: at most side * side rows
    kept = [c for c in keyed.columns if c not in ("_b", "_k", "_h")]
    best = first.groupBy("_to").agg(F.min_by(F.struct(*kept, "_k", "_h"), "_h").alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in kept], F.col("r._k").alias("_k"), F.col("r._h").alias("_h"), F.col("_to").alias("_b"))
    rows = keyed.withColumn("_end", F.lit(0)).unionByName(best.withColumn("_end", F.lit(1)))
    order = Window.partitionBy("_b").orderBy("_end", F.desc("_k"), "_h")
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns} | {"order": F.row_number().over(order).cast("long")}).where("_end = 0").drop("_b", "_k", "_h", "_end")


def edited(text: Column, following: Column) -> Column:
    """The last half (rounded down) of the code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as the long fp."""
    return fingerprint_rows(keyed_text(docs, id_col, text_col), ["text"]).withColumnRenamed("fp_0", "fp")


def within_radius(fps: DataFrame, radius: int, blocks: int | None = None, fp_col: str = "fp") -> DataFrame:
    """All pairs of different fingerprints at most radius bits apart, as (fp_a, fp_b, distance) with fp_a < fp_b.

    The bits are cut into blocks; each choice of blocks - radius of them is a permuted table whose key those blocks
    are: two fingerprints within the radius agree on at least one key, and come out of the first table of these. Equal
    fingerprints are one class, so copies are not paired; membership is a join of fps on the fingerprint. Both sides of
    the join are plain shuffles of a written table, so that Spark splits a crowded key. Null fingerprints match nothing.
    """
    blocks = blocks or radius + 3
    if not 0 < radius < blocks <= BITS:
        raise ValueError("0 < radius < blocks <= 64 is needed")
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in masks])
    classes = settle(fps.select(F.col(fp_col).cast("long").alias("fp")).where("fp is not null").distinct())
    keyed = classes.select("fp", F.posexplode(F.transform(signed, lambda m: F.col("fp").bitwiseAND(m))).alias("tab", "key"))
    a, b = keyed.withColumnRenamed("fp", "fp_a"), keyed.withColumnRenamed("fp", "fp_b")
    apart = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    near = a.join(b, ["tab", "key"]).where("fp_a < fp_b").withColumn("distance", F.bit_count(apart)).where(F.col("distance") <= radius)
    first = ~F.exists(F.slice(signed, F.lit(1), F.col("tab")), lambda m: apart.bitwiseAND(m) == 0)
    return near.where(first).select("fp_a", "fp_b", "distance")


def neighbours(fps: DataFrame, radius: int, fp_col: str = "fp") -> DataFrame:
    """fp and n_within, how many rows of fps have a fingerprint at most radius bits from it, its own ones included."""
    rows = settle(fps.select(F.col(fp_col).cast("long").alias("fp")).where("fp is not null").groupBy("fp").agg(F.count("*").alias("n")))
    pairs = within_radius(rows, radius)
    both = pairs.select(F.col("fp_a").alias("fp"), F.col("fp_b").alias("other")).union(pairs.select(F.col("fp_b").alias("fp"), F.col("fp_a").alias("other")))
    others = both.join(rows.select(F.col("fp").alias("other"), "n"), "other").select("fp", "n")
    return others.union(rows.select("fp", "n")).groupBy("fp").agg(F.sum("n").alias("n_within"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, how alike they are, and how many documents have a
    fingerprint within RADIUS bits.

    Repeated rows come out as often as they are there. A single document is its own next one.
    """
    rows = with_next(keyed_text(table(spark, sf_dir, "documents")), ["text"])
    rows = rows.select("doc_id", "order", "text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "order", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "text", "edited")
    found = settle(fingerprint_rows(rows, ["text", "edited"]))
    near = settle(neighbours(found, RADIUS, "fp_0"))
    pairs = with_next(found, ["fp_0"]).join(near, F.col("fp_0") == F.col("fp"))
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp_0")).alias("fingerprint"),
        as_text(F.col("fp_1")).alias("edited_fingerprint"),
        likeness(F.col("fp_0"), F.col("fp_1")).alias("near_edited"),
        likeness(F.col("fp_0"), F.col("next_fp_0")).alias("near_next"),
        "n_within",
    )
