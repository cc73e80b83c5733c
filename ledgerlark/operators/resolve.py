"""Noisy constituency names and optional identifiers to one canonical row each, or a reason why not.

A batch of requests is one plan: requests join the reference tables by equal keys (codes, normalised names, scopes,
and for names without a scope the rarest three letters of their longest word), and the outcome is the first branch of
a ladder that applies. Names are scored within the scope: bounds of all scores in SQL, scores of those that can matter by
an Arrow UDF. No choice is ever made on a tie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions import text as T
from ledgerlark.functions.fuzzy import bag, bound, partial_ratio_udf
from ledgerlark.sources.tables import written

RESOLVED, NOT_FOUND, AMBIGUOUS = "resolved", "unresolved_not_found", "unresolved_ambiguous"
SCOPE_REQUIRED, SCOPE_CONFLICT = "unresolved_scope_required", "unresolved_scope_conflict"
REFERENCE_UNAVAILABLE, UNVERIFIED, WEAK_MATCH = "unresolved_reference_unavailable", "unresolved_unverified", "weak_match"
THRESHOLD, TOP, UNSCOPED_CAP, UNCONFIRMED = 65, 5, 200, 0.3
#: So many rows of each name are scored first, by their bounds.
FIRST = 12


def alias_targets(aliases: DataFrame) -> DataFrame:
    """kind, alias (normalised), state_code and ac_number of each distinct target."""
    return aliases.select("kind", T.norm_text(F.col("alias")).alias("alias"), "state_code", F.col("ac_number").try_cast("int").alias("ac_number")).distinct()


def alias_sets(aliases: DataFrame) -> DataFrame:
    """kind, alias (normalised) and the set of its targets: a state's code, or code/number."""
    target = F.when(F.col("kind") == "state", F.col("state_code")).otherwise(F.concat_ws("/", "state_code", "ac_number"))
    return aliases.groupBy("kind", T.norm_text(F.col("alias")).alias("alias")).agg(F.sort_array(F.collect_set(target)).alias("targets"))


def _only(found: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """The values of each key that has just one row of them; nothing for other keys."""
    rows = found.select(*keys, F.struct(*values).alias("v")).groupBy(*keys).agg(F.min("v").alias("v"), F.max("v").alias("w"))
    return rows.where(F.col("v") == F.col("w")).select(*keys, *[F.col(f"v.{x}").alias(x) for x in values])


def _spelled(table: DataFrame, *names: str) -> DataFrame:
    """table with `name`, a row for each of its names in lower case and trimmed."""
    return table.withColumn("name", F.explode(F.array_distinct(F.array(*[F.lower(F.trim(n)) for n in names])))).where("name is not null")


def _look_up(rows: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join of requests on keys that are unique in table; on: column of rows -> column of table. Requests without a key
    are dealt out by their req_id: a null would bring all of them into one task."""
    text_of = lambda names: F.xxhash64(*[F.col(c).cast("string") for c in names])
    keyed = table.select(*[F.col(c).alias(f"_on_{c}" if c in on.values() else c) for c in table.columns]).withColumn("_on_deal", text_of([f"_on_{c}" for c in on.values()]))
    none = reduce(lambda x, c: x | F.col(c).isNull(), on, F.lit(False))
    condition = F.col("_deal") == F.col("_on_deal")
    for left, right in on.items():
        condition = condition & (F.col(left) == F.col(f"_on_{right}"))
    dealt = rows.withColumn("_deal", F.when(none, F.xxhash64("req_id")).otherwise(text_of(on)))
    return dealt.join(keyed, condition, "left").drop("_deal", "_on_deal", *[f"_on_{c}" for c in on.values()])


def scopes(requests: DataFrame, states: DataFrame, districts: DataFrame, targets: DataFrame | None) -> DataFrame:
    """requests with scope_state, scope_district and conflict (a text, or null).

    A code wins over a name, even if it is unknown. A district is looked up by its code without the state, so that a
    contradiction shows; by its name within the state if that is known, and only if just one has it. Codes are unique.
    """
    s = states.select("state_id", F.trim("state_code").alias("code"), "state_name_en", "state_name_hi")
    r = requests.withColumn("_s", F.nullif(T.norm_text(F.col("state_name")), F.lit(""))).withColumn("_sc", F.nullif(F.trim("state_code"), F.lit("")))
    r = r.withColumn("_dc", F.nullif(F.trim("district_lgd_code"), F.lit(""))).withColumn("_d", F.nullif(T.norm_text(T.strip_prefix(F.col("district_name"), T.DISTRICT_LABEL)), F.lit("")))
    r = _look_up(r, s.select("code", F.col("state_id").alias("code_state")), {"_sc": "code"})
    r = _look_up(r, _only(_spelled(s, "state_name_en", "state_name_hi"), ["name"], "state_id").select("name", F.col("state_id").alias("name_state")), {"_s": "name"})
    if targets is not None:
        alias = targets.where("kind = 'state'").select("alias", F.col("state_code").alias("code")).join(s.select("state_id", "code"), "code")
        r = _look_up(r, _only(alias, ["alias"], "state_id").select("alias", F.col("state_id").alias("alias_state")), {"_s": "alias"})
    else:
        r = r.withColumn("alias_state", F.lit(None).cast("int"))
    r = r.withColumn("_state", F.when(F.col("_sc").isNotNull(), F.col("code_state")).otherwise(F.coalesce("name_state", "alias_state")))
    d = districts.select("district_id", F.col("state_id").alias("of_state"), F.trim("lgd_district_code").alias("code"), "district_name_en", "district_name_hi")
    named = _spelled(d, "district_name_en", "district_name_hi")
    r = _look_up(r, d.select("code", F.col("district_id").alias("code_district"), F.col("of_state").alias("code_ds")), {"_dc": "code"})
    r = _look_up(r, _only(named, ["name"], "district_id", "of_state").select("name", F.col("district_id").alias("any_district"), F.col("of_state").alias("any_ds")), {"_d": "name"})
    r = _look_up(r, _only(named, ["name", "of_state"], "district_id").select("name", "of_state", F.col("district_id").alias("in_district")), {"_d": "name", "_state": "of_state"})
    by_name = F.when(F.col("_state").isNull(), F.col("any_district")).otherwise(F.col("in_district"))
    by_name_ds = F.when(F.col("_state").isNull(), F.col("any_ds")).when(F.col("in_district").isNotNull(), F.col("_state"))
    r = r.withColumn("scope_district", F.when(F.col("_dc").isNotNull(), F.col("code_district")).otherwise(by_name))
    r = r.withColumn("_ds", F.when(F.col("_dc").isNotNull(), F.col("code_ds")).otherwise(by_name_ds))
    conflict = F.when(F.col("_state").isNotNull() & F.col("_ds").isNotNull() & (F.col("_state") != F.col("_ds")), F.lit("the district is not in the state"))
    return r.select(*requests.columns, F.coalesce("_state", "_ds").alias("scope_state"), "scope_district", conflict.alias("conflict"))


def _by_scope(district: str, state: str, anywhere: str):
    """The value of the strongest scope that a request has."""
    return F.when(F.col("scope_district").isNotNull(), F.col(district)).when(F.col("scope_state").isNotNull(), F.col(state)).otherwise(F.col(anywhere))


def _letters(c: Column) -> Column:
    """The runs of three letters of a text (all of it if it is shorter)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def _with_token(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """token and id of the rows with a name that contains it. A token meets the rows by its rarest three letters, so that
    a beginning that all names share does not bring all of them together."""
    spelled = rows.select("id", F.explode(F.array_compact(F.array(F.lower("constituency"), F.lower("constituency_hindi")))).alias("_low"))
    grams = spelled.select("id", "_low", F.explode(_letters(F.col("_low"))).alias("_g"))
    often = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    own = tokens.select("token", F.lower("token").alias("_t")).select("token", "_t", F.explode(_letters(F.col("_t"))).alias("_g")).join(often, "_g", "left")
    rarest = own.groupBy("token", "_t").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_g")).alias("_r")).select("token", "_t", F.col("_r._g").alias("_g"))
    return rarest.join(grams, "_g").where(F.contains("_low", F.col("_t"))).select("token", "id").distinct()


def _sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows each key has, and how many with a name in either script."""
    named = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), named("constituency").alias("n_english"), named("constituency_hindi").alias("n_local"))


def _pairs(names: DataFrame, rows: DataFrame, hits: DataFrame) -> list[DataFrame]:
    """Each name with the rows of its scope."""
    return [
        names.where("scope = 'd'").join(rows, F.col("scope_district") == F.col("district_id")),
        names.where("scope = 's'").join(rows, F.col("scope_state") == F.col("state_id")),
        names.where("scope = 't'").join(hits.withColumnRenamed("token", "_token"), F.col("token") == F.col("_token")).drop("_token").join(rows, "id"),
    ]


def _keys(texts: DataFrame, whole: bool, lengths: DataFrame) -> DataFrame:
    """texts (rep or id, scope, group, local, x) with h, a hash of each key that x has as the shorter text (whole), or as the
    longer one for all shorter ones of these lengths. A key is shared by two texts if the longer one contains the shorter
    one, or begins or ends with it but for one of its characters, which it lacks."""
    key = lambda m, cut, t: F.struct(m.alias("m"), F.lit(cut).alias("cut"), t.alias("t"))
    n = F.char_length("x")
    every = lambda most: F.sequence(F.lit(1), most)
    if whole:
        less = F.transform(every(n), lambda i: key(n, True, F.concat(F.substring("x", F.lit(1), i - 1), F.substring("x", i + 1, n))))
        found = texts.join(F.broadcast(lengths)).where(n <= F.array_max("lengths"))  # lengths: one row
        keys = F.concat(F.array(key(n, False, F.col("x"))), F.when(n > 1, less).otherwise(F.slice(less, 1, 0)))
    else:
        of = lambda m: F.concat(F.transform(every(n - m + 1), lambda i: key(m, False, F.substring("x", i, m))), F.array(key(m, True, F.substring("x", F.lit(1), m - 1)), key(m, True, F.substring("x", n - m + 2, m - 1))))
        found = texts.join(F.broadcast(lengths))  # lengths: one row
        keys = F.flatten(F.transform(F.filter("lengths", lambda m: m <= n), of))
    return found.select(*[c for c in texts.columns if c != "x"], F.explode(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))).alias("h"))


def _close(names: DataFrame, rows: DataFrame) -> DataFrame:
    """rep and id of all pairs within a scope that differ by no more than one character of the shorter text: every other
    pair has a score of at most 100 - 100 / length of the name. No pairs of a scope are formed but these."""
    n = names.where("scope <> 't'").select("rep", "scope", F.when(F.col("scope") == "d", F.col("scope_district")).otherwise(F.col("scope_state")).alias("group"), "local", F.col("asked_name").alias("x")).where("x <> ''")
    scope = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).cast("long").alias("group")) for s, c in (("d", "district_id"), ("s", "state_id"))])).alias("s")
    value = F.explode(F.array(*[F.struct(F.lit(b).alias("local"), F.col(c).alias("x")) for b, c in ((False, "constituency"), (True, "constituency_hindi"))])).alias("v")
    n = n.withColumn("group", F.col("group").cast("long"))
    own = rows.select("id", scope, "constituency", "constituency_hindi").select("id", "s.*", value).select("id", "scope", "group", "v.*").where("x <> ''")
    own = own.join(n.select("scope", "group", "local").distinct(), ["scope", "group", "local"], "left_semi")
    lengths = lambda df: df.agg(F.collect_set(F.char_length("x")).alias("lengths"))
    on = ["scope", "group", "local", "h"]
    one, other = lengths(n), lengths(own)
    a = _keys(n, True, other).join(_keys(own, False, one), on)
    b = _keys(own, True, one).join(_keys(n, False, other), on)
    return a.select("rep", "id").union(b.select("rep", "id")).distinct()


def _scored(unsure: DataFrame, rows: DataFrame) -> DataFrame:
    """req_id, pool (rows of its scope, or with its longest word), scorable (those with a name in its script) and top (the
    best by score; within a scope those with the best score at least). Sizes are looked up, not counted over pairs; equal requests are scored once, and those without a scope
    only within the cap."""
    scope = F.when(F.col("scope_district").isNotNull(), F.lit("d")).when(F.col("scope_state").isNotNull(), F.lit("s")).otherwise(F.lit("t"))
    asked = written(unsure.withColumn("scope", scope))
    # Requests, tokens and sizes are tables of their own, so that no plan holds the scopes' look-ups several times.
    hits = _with_token(asked.where("scope = 't' and token is not null").select("token").distinct(), rows)
    per_token = _sizes(hits.join(rows, "id"), "token")
    sized = [
        asked.where("scope = 'd'").join(_sizes(rows, "district_id").withColumnRenamed("district_id", "scope_district"), "scope_district", "left"),
        asked.where("scope = 's'").join(_sizes(rows, "state_id").withColumnRenamed("state_id", "scope_state"), "scope_state", "left"),
        asked.where("scope = 't'").join(per_token, "token", "left"),
    ]
    sized = reduce(DataFrame.unionByName, sized).select(*asked.columns, "n_rows", "n_english", "n_local")
    sized = sized.withColumn("pool", F.coalesce("n_rows", F.lit(0))).withColumn("scorable", F.coalesce(F.when(F.col("local"), F.col("n_local")).otherwise(F.col("n_english")), F.lit(0)))
    sized = written(sized)
    keys = ["scope", "cleaned", "local", "scope_district", "scope_state", "token"]
    names = sized.where((F.col("scope") != "t") | (F.col("pool") <= UNSCOPED_CAP)).where("scorable > 0").groupBy(*keys).agg(F.min("req_id").alias("rep"))
    value = F.when(F.col("local"), F.col("constituency_hindi")).otherwise(F.col("constituency"))
    # Bounds need no Python: the best of each name by bound are scored, and then those that can still be among the best.
    bags = lambda df, *columns: reduce(lambda d, c: d.withColumn(f"{c}_bag", bag(F.col(c))), columns, df)
    sides = {"names": written(bags(names.withColumn("asked_name", T.nfc(F.col("cleaned"))), "asked_name")), "rows": written(bags(rows.withColumns({c: T.nfc(F.col(c)) for c in ("constituency", "constituency_hindi")}), "constituency", "constituency_hindi"))}
    def scored(some: DataFrame) -> DataFrame:
        with_names = some.join(sides["names"].select("rep", "asked_name", "local"), "rep").join(sides["rows"].select("id", F.col("state_id").alias("row_state"), "constituency", "constituency_hindi"), "id")
        return with_names.select("rep", "id", "row_state", partial_ratio_udf(F.col("asked_name"), value).alias("score"))

    # Within a scope the best alone decides: a name that has close rows needs no others.
    close = written(scored(_close(sides["names"], sides["rows"])))
    best = close.groupBy("rep").agg(F.max("score").alias("score")).join(sides["names"].select("rep", "asked_name"), "rep")
    settled = written(best.where(F.col("score") > 100 - 100 / F.char_length("asked_name") + 1e-9).select("rep", "score"))
    open_names = sides["names"].join(settled, "rep", "left_anti")
    pairs = reduce(DataFrame.unionByName, _pairs(open_names, sides["rows"], hits)).where(F.coalesce(value, F.lit("")) != "")
    value_bag = F.when(F.col("local"), F.col("constituency_hindi_bag")).otherwise(F.col("constituency_bag"))
    bounds = written(pairs.select("rep", "id", bound(F.col("asked_name"), value, F.col("asked_name_bag"), value_bag).alias("most")))

    first = bounds.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("most"), "id"))).where(F.col("place") <= FIRST)
    near = written(scored(first))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= TOP)
    least = ranked(near).groupBy("rep").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    able = bounds.join(least, "rep").where((F.col("n") < TOP) | (F.col("most") >= F.col("least"))).join(near.select("rep", "id"), ["rep", "id"], "left_anti")
    top = ranked(near.union(scored(able)).union(close.join(settled, ["rep", "score"]).select(*near.columns)))
    top = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "row_state", "score"))).alias("top"))
    same = reduce(lambda x, k: x & F.col(f"a.{k}").eqNullSafe(F.col(f"n.{k}")), keys, F.lit(True))
    found = sized.alias("a").join(names.join(top, "rep").alias("n"), same, "left")
    return found.select("a.req_id", "a.pool", "a.scorable", "n.top")


def resolve(requests: DataFrame, constituencies: DataFrame, states: DataFrame, districts: DataFrame, aliases: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """req_id, status, method, score, match_id, candidates (ids in order), required and reason of each request.

    Equal scores are ordered by id. req_id is unique and not null. Without fuzzy, names are not scored, and what has no
    exact match is as if no row were in its scope.
    """
    targets = alias_targets(aliases) if aliases is not None else None
    r = scopes(requests, states, districts, targets)
    bare = T.strip_prefix(F.col("name"), T.CONSTITUENCY_LABEL)
    r = r.withColumn("cleaned", T.name_without_number(bare)).withColumn("prefix_no", T.number_in_name(bare)).withColumn("key", T.norm_text(F.col("cleaned"))).withColumn("token", T.longest_token(F.col("key")))
    r = r.withColumn("number", F.coalesce("ac_number", "prefix_no")).drop("state_code", "state_name", "district_name", "district_lgd_code")
    rows = constituencies.select("id", "constituency", "constituency_hindi", "district_id", "state_id", F.col("ac_number").alias("row_number"))

    # Exact: equal normalised names, and sourced aliases, in the scope.
    keyed = _spelled(rows, "constituency", "constituency_hindi").select("name", "id", "district_id", "state_id")
    if targets is not None:
        own = targets.where("kind = 'constituency'").join(states.select("state_id", F.trim("state_code").alias("state_code")), "state_code").select(F.col("alias").alias("name"), "state_id", F.col("ac_number").alias("row_number"))
        keyed = keyed.union(own.join(rows, ["state_id", "row_number"]).select("name", "id", "district_id", "state_id"))
    ids_of = lambda out, *keys: keyed.groupBy(*keys).agg(F.sort_array(F.collect_set("id")).alias(out)).select(*[F.col(k).alias(f"{out}_{k}") for k in keys], out)
    for out, on in (("exact_d", {"key": "name", "scope_district": "district_id"}), ("exact_s", {"key": "name", "scope_state": "state_id"}), ("exact_a", {"key": "name"})):
        r = _look_up(r, ids_of(out, *on.values()), {k: f"{out}_{v}" for k, v in on.items()})
    r = r.withColumn("exact", F.when(F.col("key") != "", _by_scope("exact_d", "exact_s", "exact_a")))

    # Rows of the scope without a local name make a fuzzy match in that script unsafe.
    lacking = rows.where("constituency_hindi is null")
    by_d, by_s = (lacking.groupBy(c).agg(F.count(F.lit(1)).alias("g")) for c in ("district_id", "state_id"))
    every = lacking.agg(F.count(F.lit(1)).alias("g_all"))
    r = r.join(by_d.select(F.col("district_id").alias("scope_district"), F.col("g").alias("g_d")), "scope_district", "left").join(by_s.select(F.col("state_id").alias("scope_state"), F.col("g").alias("g_s")), "scope_state", "left").join(F.broadcast(every))  # every: one row
    gap = F.when(F.col("scope_district").isNotNull(), F.coalesce("g_d", F.lit(0))).when(F.col("scope_state").isNotNull(), F.coalesce("g_s", F.lit(0))).otherwise(F.col("g_all"))
    r = r.withColumn("local", T.has_devanagari(F.col("cleaned"))).withColumn("gap", F.when(F.col("local"), gap).otherwise(F.lit(0)))

    unsure = r.where("conflict is null and key <> '' and exact is null and gap = 0").select("req_id", "cleaned", "local", "token", "scope_district", "scope_state")
    none = F.lit(None)
    if fuzzy:
        r = r.join(written(_scored(unsure, rows)), "req_id", "left")
    else:
        r = r.withColumns({"pool": none.cast("long"), "scorable": none.cast("long"), "top": none.cast("array<struct<rank:int,id:int,row_state:int,score:double>>")})

    # What the identifiers say.
    r = _look_up(r, rows.select(F.col("id").alias("by_id"), F.col("id").alias("found_id"), F.col("district_id").alias("id_district"), F.col("state_id").alias("id_state")), {"constituency_id": "by_id"})
    inside = F.when(F.col("scope_district").isNotNull(), F.col("scope_district") == F.col("id_district")).when(F.col("scope_state").isNotNull(), F.col("scope_state") == F.col("id_state")).otherwise(F.lit(True))
    r = r.withColumn("id_row", F.when(inside, F.col("found_id")))
    for out, scope, column in (("no_d", "scope_district", "district_id"), ("no_s", "scope_state", "state_id")):
        table = rows.groupBy(column, "row_number").agg(F.min("id").alias(out)).select(F.col(column).alias(f"{out}_scope"), F.col("row_number").alias(f"{out}_number"), out)
        r = _look_up(r, table, {scope: f"{out}_scope", "number": f"{out}_number"})
    r = r.withColumn("no_row", F.when(F.col("scope_state").isNotNull(), _by_scope("no_d", "no_s", "no_s")))
    return _decide(r)


def _decide(r: DataFrame) -> DataFrame:
    c, none = F.col, F.lit(None)
    unscoped = c("scope_state").isNull()
    ids = lambda *xs: F.array(*[x.cast("int") for x in xs])
    words = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")

    def outcome(status: str, method=None, score=None, match=None, candidates=None, required=None, reason=""):
        return F.struct(
            F.lit(status).alias("status"), F.lit(method).cast("string").alias("method"), (none if score is None else score).cast("double").alias("score"), (none if match is None else match).cast("int").alias("match_id"),
            (ids() if candidates is None else candidates).cast("array<int>").alias("candidates"), (words() if required is None else required).alias("required"), F.lit(reason).alias("reason"),
        )

    narrower = F.when(unscoped, words("state_code", "district_lgd_code")).otherwise(words("district_lgd_code"))
    best = F.get("top", F.lit(0))
    tied = F.filter("top", lambda t: t["score"] == best["score"])
    plausible = F.filter("top", lambda t: t["score"] >= THRESHOLD)
    pick = lambda a: F.transform(a, lambda t: t["id"])
    pool = F.coalesce("pool", F.lit(0))
    r = r.withColumn(
        "by_name",
        F.when(c("key") == "", outcome(NOT_FOUND, required=words("assembly_constituency_name"), reason="no name was given"))
        .when(F.size("exact") == 1, outcome(RESOLVED, "exact", F.lit(100.0), F.get("exact", F.lit(0)), reason="exact name in the scope"))
        .when(F.size("exact") > 1, outcome(AMBIGUOUS, "exact", None, None, c("exact"), narrower, "several rows have the name"))
        .when(c("gap") > 0, outcome(REFERENCE_UNAVAILABLE, "fuzzy", required=words("district_lgd_code"), reason="rows of the scope have no local name"))
        .when(unscoped & (c("token").isNull() | (pool > UNSCOPED_CAP)), outcome(SCOPE_REQUIRED, required=words("state_code"), reason="too broad without a scope"))
        .when(pool == 0, F.when(unscoped, outcome(NOT_FOUND, required=words("state_code"), reason="no name has its longest word")).otherwise(outcome(NOT_FOUND, reason="no row in the scope")))
        .when(F.coalesce("scorable", F.lit(0)) == 0, outcome(NOT_FOUND, reason="no name in its script in the scope"))
        .when(best["score"] < THRESHOLD, outcome(NOT_FOUND, "fuzzy", best["score"], reason="below the threshold"))
        .when(F.size(tied) > 1, outcome(AMBIGUOUS, "fuzzy", best["score"], None, pick(tied), narrower, "several rows have the best score"))
        .when(unscoped & (F.size(F.array_distinct(F.transform(plausible, lambda t: t["row_state"]))) > 1), outcome(AMBIGUOUS, "fuzzy", best["score"], None, pick(plausible), words("state_code"), "plausible rows in several states"))
        .otherwise(outcome(RESOLVED, "fuzzy", best["score"], best["id"], reason="fuzzy match in the scope")),
    )
    name = c("by_name")
    row = F.coalesce("no_row", "id_row")
    conflict = lambda why: outcome(SCOPE_CONFLICT, required=words("state_code", "district_lgd_code"), reason=why)
    confirmed = name.withField("reason", F.concat(name["reason"], F.lit("; confirmed by identifier"))).withField("method", F.when(name["method"] == "fuzzy", F.lit("identifier")).otherwise(name["method"]))
    chosen = outcome(RESOLVED, "identifier", name["score"], row, reason="the identifier is one of the candidates")
    final = (
        F.when(c("conflict").isNotNull(), conflict("the district is not in the state"))
        .when(c("ac_number").isNotNull() & c("prefix_no").isNotNull() & (c("ac_number") != c("prefix_no")), conflict("the number contradicts the one in the name"))
        .when(c("constituency_id").isNotNull() & c("id_row").isNull(), conflict("no such constituency in the scope"))
        .when(c("number").isNotNull() & ~unscoped & c("no_row").isNull(), conflict("no such number in the scope"))
        .when(c("id_row").isNotNull() & c("no_row").isNotNull() & (c("id_row") != c("no_row")), conflict("the constituency has another number"))
        .when(row.isNull(), name)
        .when((name["status"] == RESOLVED) & (name["match_id"] == row), confirmed)
        .when(name["status"] == RESOLVED, conflict("the name is another row than the identifier"))
        .when(F.array_contains(name["candidates"], row), chosen)
        .otherwise(outcome(UNVERIFIED, "identifier", candidates=ids(row), required=words("assembly_constituency_name"), reason="the name does not confirm the identifier"))
    )
    return r.select("req_id", final.alias("o")).select("req_id", "o.*")


def confirm(raw: Column, status: Column, method: Column, canonical: Column, suggestion: Column, match_id: Column | None = None) -> Column:
    """A field after resolution: the raw text stays, with low confidence, unless it was resolved by more than a score.
    With match_id, the field also has the id that it was resolved to."""
    weak = (status == RESOLVED) & (method == "fuzzy")
    sure = (status == RESOLVED) & ~weak
    own = [] if match_id is None else [F.when(sure, match_id).alias("constituency_id")]
    return F.struct(F.when(sure, canonical).otherwise(raw).alias("value"), F.when(sure, F.lit(0.99)).otherwise(F.lit(UNCONFIRMED)).alias("confidence"), raw.alias("raw_value"), F.when(weak, F.lit(WEAK_MATCH)).otherwise(status).alias("resolution_status"), F.when(weak, canonical).when(status == UNVERIFIED, suggestion).alias("suggested_value"), *own)


def fill_district(district: Column, confidence: Column, status: Column, method: Column, local_name: Column) -> Column:
    """The district's value and confidence: an empty one is taken from a resolution that is more than a score."""
    name = T.strip_prefix(local_name, T.DISTRICT_LABEL)
    taken = (F.coalesce(district, F.lit("")) == "") & (status == RESOLVED) & ~F.coalesce(method == "fuzzy", F.lit(False)) & (F.coalesce(local_name, F.lit("")) != "")
    return F.struct(F.when(taken, name).otherwise(district).alias("value"), F.when(taken, F.lit(0.99)).otherwise(confidence).alias("confidence"))


def save_gate(status: Column, method: Column) -> Column:
    """The error code that saving a record meets; null if it may be saved."""
    return F.when(status == NOT_FOUND, F.lit("INVALID_CONSTITUENCY")).when(status != RESOLVED, F.lit("AMBIGUOUS_CONSTITUENCY")).when(method == "fuzzy", F.lit("CONSTITUENCY_CONFIRMATION_REQUIRED"))
