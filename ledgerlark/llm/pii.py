"""Personal data: pattern spans, and terms that disclose whose they are, in DataFrame operations only.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers; secrets (keys and tokens) are spans of a kind
of their own. Each distinct value is a protected entity c. The corpus then tells how much a term t says about it: over
all N documents, with n(c) that hold the entity, n(t) that hold the term, and n(c, t) that hold both, the term within
BLOCK to twice BLOCK code points of the entity at least,

    PMI(c; t) = log2(N n(c, t) / (n(c) n(t)))    and    IC(c) = log2(N / n(c)) >= PMI(c; t).

A term whose PMI reaches the share `disclosure` of IC, and LEAST_BITS, gives the entity away, if they meet in `support`
documents or more: one document is no estimate of what goes together. All its occurrences in each document that holds the entity, near to it or not, are added as spans of kind "term".
They are generalised to the class of the word, or removed if nearly all documents with the term hold the entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import settle, table

#: The kinds in the order of the result and their patterns. Quantifiers are possessive and starts are
#: tied to the run's first character (or the end of the last match), which leaves the matches as they are and the
#: time in proportion to the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
}
#: A text without a match of this has none of the kind.
CUES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_]{20}"}
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "term", "secret"]
TERM = KINDS.index("term")
#: Runs of digits in letters that a secret has at least; words and file names have fewer.
SECRET_RUNS = 4

#: Entities and terms meet in blocks of so many code points and in neighbouring blocks; a term must have MIN_LETTERS letters.
BLOCK, MIN_LETTERS = 4096, 3
#: Share of IC, bits and documents that make a disclosure, and the share of its documents from which a term is removed instead of generalised.
DISCLOSURE, LEAST_BITS, SUPPORT, REMOVE = 0.9, 4.0, 2, 0.9
LETTERS = r"\p{L}+"


def _found(text: Column, name: str) -> Column:
    """Matches of one kind with the length of the text before each; empty without a cue."""
    kind = KINDS.index(name)
    gaps, values = F.transform(F.split(text, PATTERNS[name], -1), F.length), F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0))
    rows = lambda g, v: F.transform(v, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("k"), F.get(g, i).alias("gap"), x.alias("value")))
    both = F.element_at(F.transform(F.array(F.struct(gaps.alias("g"), values.alias("v"))), lambda s: rows(s["g"], s["v"])), 1)
    cue = F.contains(text, F.lit("@")) if name == "email" else text.rlike(CUES[name])
    return F.when(cue, both)


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1))),
        F.lit(0),
        lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d),
    )
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    low = lambda part: F.coalesce(F.regexp_replace(part, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False))  # noqa: E731  too long for an int: over 255
    parts = F.split(value, r"\.")
    ip = low(F.get(parts, F.lit(0))) & low(F.get(parts, F.lit(1))) & low(F.get(parts, F.lit(2))) & low(F.get(parts, F.lit(3)))
    runs = F.regexp_count(value, F.lit("[0-9]++")) >= SECRET_RUNS
    rules = {"email": F.lit(True), "ip": ip, "card": F.length(digits).between(16, 19) & _luhn(digits), "phone": F.length(digits).between(8, 15), "secret": runs & value.rlike("[A-Za-z]")}
    return reduce(lambda done, name: done.when(kind == KINDS.index(name), rules[name]), list(rules)[1:], F.when(kind == 0, rules["email"]))


def _searched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with its matches, valid or not, and with its text if one may be valid: row, doc_id, t1 and t2 (the
    text's hashes), found, text. Written once; row numbers the rows of this table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<kind:int,k:int,gap:int,value:string>>")
    found = F.concat(*[F.coalesce(_found(F.col("text"), name), none) for name in PATTERNS])
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), found.alias("found"), "text")
    may = F.exists("found", lambda m: (m["kind"] != KINDS.index("card")) | (F.length(m["value"]) >= 16))
    return settle(rows.withColumn("text", F.when(may, F.col("text"))))


def _spans(searched: DataFrame) -> DataFrame:
    """row, kind, entity, start and stop of the valid matches."""
    each = searched.where(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("gap") + F.length("value")).over(order).cast("long")).withColumn("start", F.col("stop") - F.length("value"))
    return placed.where(_valid(F.col("kind"), F.col("value"))).select("row", "kind", F.xxhash64("kind", F.lower("value")).alias("entity"), "start", "stop")


def _terms(searched: DataFrame, found: DataFrame) -> DataFrame:
    """row, term, start, stop and whether it is capitalised, of each word outside the spans, in the rows that have spans."""
    own = searched.join(found.select("row").distinct(), "row", "left_semi")
    parts = F.arrays_zip(F.transform(F.split("text", LETTERS, -1), F.length).alias("gap"), F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)).alias("word"))
    each = own.select("row", F.posexplode(parts).alias("k", "x")).select("row", "k", "x.*").where("word is not null")
    so_far = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    words = each.withColumn("stop", F.sum(F.col("gap") + F.length("word")).over(so_far).cast("long")).select("row", "word", (F.col("stop") - F.length("word")).alias("start"), "stop")
    # Spans and words in one order: a word is free if no span before it reaches it and the next one begins after it.
    events = words.withColumn("edge", F.lit(None).cast("long")).unionByName(found.select("row", F.lit(None).cast("string").alias("word"), "start", "stop", F.col("stop").alias("edge")))
    order = Window.partitionBy("row").orderBy("start", F.col("word").asc_nulls_first())
    reach = F.coalesce(F.max("edge").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) <= F.col("start")
    ahead = F.coalesce(F.lead(F.when(F.col("edge").isNotNull(), F.col("start"))).over(order) >= F.col("stop"), F.lit(True))
    free = events.withColumn("free", reach & ahead).where("word is not null and free").where(F.length("word") >= MIN_LETTERS)
    return free.select("row", F.lower("word").alias("term"), "start", "stop", (F.left("word", F.lit(1)) != F.lower(F.left("word", F.lit(1)))).alias("capital"))


def disclosures(found: DataFrame, terms: DataFrame, docs: DataFrame, n: int, text_col: str = "text", disclosure: float = DISCLOSURE, bits: float = LEAST_BITS, support: int = SUPPORT) -> DataFrame:
    """entity, term, pmi, ic and share (of the documents with the term) of the pairs that reach the thresholds.

    n: the number of documents. Of a document's terms only those go into pairs that are rare enough to disclose one of
    its entities: n(t) <= n(c) 2^((1 - disclosure) IC(c)).
    """
    words = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"\P{L}+"), F.lower))
    counts = settle(docs.select(F.explode(words).alias("term")).where(F.length("term") >= MIN_LETTERS).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support))
    entities = settle(found.groupBy("row", "entity").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("n_c")))
    ic = F.log2(F.lit(float(max(n, 1))) / F.col("n_c"))
    known = entities.select("entity", "n_c", ic.alias("ic"), (F.col("n_c") * F.pow(F.lit(2.0), (1 - disclosure) * ic)).alias("most")).where(F.col("ic") >= bits)
    block = lambda at: F.floor(F.col(at) / BLOCK)
    near = found.select("row", "entity", F.explode(F.sequence(block("start") - 1, block("stop") + 1)).alias("block")).distinct()
    rare = terms.select("row", "term", block("start").alias("block")).distinct().join(counts, "term")
    met = near.join(known, "entity").join(rare, ["row", "block"]).where("n_t <= most")
    pairs = met.groupBy("entity", "term", "row").agg(F.first("n_t").alias("n_t"), F.first("ic").alias("ic"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.first("n_t").alias("n_t"), F.first("ic").alias("ic")).where(F.col("n_ct") >= support)
    share = F.least(F.col("n_ct") / F.col("n_t"), F.lit(1.0))
    scored = pairs.select("entity", "term", (F.col("ic") + F.log2(share)).alias("pmi"), "ic", share.alias("share"))
    return scored.where((F.col("pmi") >= disclosure * F.col("ic")) & (F.col("pmi") >= bits))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, bits: float = LEAST_BITS, support: int = SUPPORT) -> DataFrame:
    """One row per document with its array `spans` of (kind as its number in KINDS, start, stop, remove, tag).

    Positions are code points, ends exclusive; tag is what takes the span's place. A null or empty text has no spans,
    repeated rows have theirs each and count as documents each, a null doc_id stays null, an empty table gives no rows,
    other columns are not read. t1 and t2 identify the text.
    """
    searched = _searched(docs, id_col, text_col)
    found = settle(_spans(searched))
    terms = settle(_terms(searched, found))
    telling = settle(disclosures(found, terms, docs, searched.count(), text_col, disclosure, bits, support).select("entity", "term", "share"))
    held = found.select("row", "entity").distinct()
    hits = settle(terms.select("row", "term").distinct().join(telling, "term").join(held, ["row", "entity"]).groupBy("row", "term").agg(F.max("share").alias("share")))
    tag = F.when(F.col("share") >= REMOVE, F.lit("")).when(F.col("capital"), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))
    added = terms.join(hits, ["row", "term"]).select("row", F.struct(F.lit(TERM).alias("kind"), "start", "stop", (F.col("share") >= REMOVE).alias("remove"), tag.alias("tag")).alias("s"))
    own = found.select("row", F.struct("kind", "start", "stop", F.lit(False).alias("remove"), F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col("kind") + 1).alias("tag")).alias("s"))
    per_row = own.unionByName(added).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:bigint,stop:bigint,remove:boolean,tag:string>>")
    return searched.select("row", "doc_id", "t1", "t2").join(per_row, "row", "left").select("doc_id", "t1", "t2", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The same rows and columns, with each span of the text replaced by its tag: [KIND], the class of a term, or nothing.

    Overlapping spans are one gap with the first one's placeholder. Texts without spans, null ones too, stay as they are.
    """
    found = spans(docs, id_col, text_col, **options).where(F.size("spans") > 0)
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["tag"].alias("tag"))))
    # Written first, so that a text of many copies can be split in the join.
    found = settle(found.groupBy("t1", "t2").agg(F.first(by_start).alias("cuts")))
    names = {c: f"_{c}" for c in ("t1", "t2", "cuts")}
    found = found.select(*[F.col(c).alias(f"_ledger{n}") for c, n in names.items()])
    text = F.col(text_col)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), x["tag"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    redacted = F.aggregate("_ledger_cuts", begin, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    joined = docs.withColumns({"_ledger_t1": F.xxhash64(text), "_ledger_t2": F.xxhash64(F.lit(1), text)}).join(found, ["_ledger_t1", "_ledger_t2"], "left")
    return joined.withColumn(text_col, F.when(F.col("_ledger_cuts").isNotNull() & text.isNotNull(), redacted).otherwise(text)).select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(name))).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count("term"), count("secret"))
