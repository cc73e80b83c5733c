"""Queries of claims, logs, sequences, pages, constraints, versions and staged loads, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from ledgerlark.operators import automaton, constraints, sequences, staging, versions
from ledgerlark.plans.queries import query
from ledgerlark.sources.tables import parquet, scratch
from ledgerlark.streaming import leases

EVENTS = StructType([StructField("event_id", LongType()), StructField("ts", TimestampNTZType()), StructField("user_id", LongType()), StructField("event_type", StringType()), StructField("value", DoubleType()), StructField("props", StringType())])


def _by_type(names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for kind, name in names.items():
        out = F.when(F.col("event_type") == kind, name).otherwise(out)
    return out


# Claims.

_ACTIONS = {"signup": "submit", "view": "claim", "click": "beat", "purchase": "done"}
_LEASE = timedelta(hours=12)


def requests(events: DataFrame) -> DataFrame:
    """Events as requests for the jobs that users stand for, by three workers."""
    worker = F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string"))
    return events.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("tie"), _by_type(_ACTIONS, "fail").alias("action"), worker.alias("worker"))


_REPLAY = """with recursive r as materialized (
  select user_id, ts, 'w' || (event_id % 3) as worker, case event_type when 'signup' then 'submit' when 'view' then 'claim' when 'click' then 'beat' when 'purchase' then 'done' else 'fail' end as action,
    row_number() over (partition by user_id order by ts, event_id) as n from events
), s as (
  select distinct user_id, 0::bigint as n, 'none' as status, null::varchar as owner, null::timestamp as until, 0::bigint as claims, false as granted, null::varchar as action from events
  union all
  select user_id, n, case when not ok then status when action = 'submit' then 'pending' when action in ('claim', 'beat') then 'processing' when action = 'done' then 'completed' else 'failed' end,
    case when not ok then owner when action in ('claim', 'beat') then worker end, case when not ok then until when action in ('claim', 'beat') then ts + interval 12 hour end,
    claims + (ok and action = 'claim')::bigint, ok, action from (
    select r.user_id, r.n, s.status, s.owner, s.until, s.claims, r.action, r.worker, r.ts, coalesce(case when r.action = 'submit' then s.status in ('none', 'completed', 'failed')
      when r.action = 'claim' then s.status = 'pending' or (s.status = 'processing' and r.ts > s.until) else s.status = 'processing' and r.ts <= s.until and r.worker = s.owner end, false) as ok
    from s join r on r.user_id = s.user_id and r.n = s.n + 1)
)"""


@query(
    _REPLAY
    + """ select user_id, case when status = 'processing' and until < (select max(ts) from events) then 'pending' else status end as status,
  case when not (status = 'processing' and until < (select max(ts) from events)) then owner end as owner, claims from s qualify row_number() over (partition by user_id order by n desc) = 1"""
)
def lease_owners(spark: SparkSession, d: str) -> DataFrame:
    """Who owns each job after all requests of the stream."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    steps = leases.run(spark, requests(stream), "user_id", _LEASE, scratch(spark))
    now = steps.agg(F.max("at")).first()[0]
    return leases.owners(steps, "user_id", F.lit(now))


@query(_REPLAY + " select user_id, action, granted, count(*) as n from s where n > 0 group by all")
def lease_steps(spark: SparkSession, d: str) -> DataFrame:
    """How many requests of each kind were granted and refused, by job."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    steps = leases.run(spark, requests(stream), "user_id", _LEASE, scratch(spark))
    return steps.where("action <> 'expire'").groupBy("user_id", "action", "granted").agg(F.count(F.lit(1)).alias("n"))


# The log.

_STATUSES = {"signup": "pending", "view": "processing", "click": "completed", "error": "failed"}
_LOG = """with recursive r as materialized (
  select user_id, event_id, ts, case event_type when 'signup' then 'pending' when 'view' then 'processing' when 'click' then 'completed' when 'error' then 'failed' else 'archived' end as status,
    row_number() over (partition by user_id order by ts, event_id) as n from events
), s as (
  select distinct user_id, 0::bigint as n, null::bigint as event_id, null::timestamp as ts, 'none' as before, 'none' as after, false as legal from events
  union all
  select user_id, n, event_id, ts, state, case when ok then status else state end, ok from (
    select r.user_id, r.n, r.event_id, r.ts, r.status, s.after as state,
      (s.after, r.status) in (('none', 'pending'), ('pending', 'processing'), ('processing', 'completed'), ('processing', 'failed'), ('failed', 'pending')) as ok
    from s join r on r.user_id = s.user_id and r.n = s.n + 1)
)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    return automaton.checked(parquet(spark, d, "events").select("user_id", "event_id", "ts", _by_type(_STATUSES, "archived").alias("status")), "user_id", "ts", "event_id", "status")


@query(_LOG + " select user_id, event_id, before, after, legal from s where n > 0")
def transition_log(spark: SparkSession, d: str) -> DataFrame:
    """Every step with the states before and after it; a fifth of the steps name no state, many others are out of order."""
    return _log(spark, d).select("user_id", "event_id", "before", "after", "legal")


@query(_LOG + " select user_id, arg_max(after, n) as state from s where n > 0 and ts <= timestamp '2024-01-10 00:00:00' group by 1")
def states_at(spark: SparkSession, d: str) -> DataFrame:
    return automaton.state_at(_log(spark, d), "user_id", "ts", "event_id", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


# Sequences and pages.


@query("select o_orderkey, 1000 + row_number() over (order by o_totalprice, o_orderkey) as id from orders")
def sequence_values(spark: SparkSession, d: str) -> DataFrame:
    """A sequence that stood at 1000 goes on, by price."""
    rows, _ = sequences.next_values(parquet(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "id", 1000)
    return rows.select("o_orderkey", "id")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 700")
def deep_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 15 of 50 rows, from a page index."""
    done = sequences.ordered(parquet(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")])
    return sequences.page(done, 15, 50)


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority < '3-MEDIUM' or (o_orderpriority = '3-MEDIUM' and o_orderkey > 300) order by o_orderpriority desc, o_orderkey limit 50")
def page_after(spark: SparkSession, d: str) -> DataFrame:
    """The page behind a known row."""
    return sequences.after(parquet(spark, d, "orders").select("o_orderkey", "o_orderpriority"), [("o_orderpriority", False), ("o_orderkey", True)], ("3-MEDIUM", 300), 50)


# Constraints.

_DECLARED = [
    *constraints.row_count("region", 5, 5), *constraints.not_null("nation", "n_name", "n_regionkey"), *constraints.unique("nation", "n_nationkey"), *constraints.unique("nation", "n_name"),
    *constraints.reference("nation", "n_regionkey", "region", "r_regionkey"), *constraints.reference("customer", "c_nationkey", "nation", "n_nationkey"), *constraints.unique("customer", "c_nationkey", where="c_mktsegment = 'BUILDING'"),
    *constraints.in_range("orders", "o_totalprice", 1000, 400000), *constraints.one_of("orders", "o_orderstatus", "F", "O"), *constraints.matches("orders", "o_orderpriority", "^[1-4]-"), *constraints.reference("orders", "o_custkey", "customer", "c_custkey"),
    *constraints.unique("lineitem", "l_orderkey", "l_linenumber"), *constraints.in_range("lineitem", "l_quantity", 2, None, where="l_returnflag = 'R'"), *constraints.reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
    *constraints.reference("lineitem", "l_suppkey", "supplier", "s_suppkey", where="l_linestatus = 'O'"),
]


def _extra(keys: str, table: str, where: str = "true") -> str:
    return f"(select coalesce(sum(n - 1), 0) from (select count(*) filter ({where}) as n from {table} group by {keys}) where n > 0)"


_GOT = [
    "(select count(*) from region)", "(select count(*) from nation where n_name is null)", "(select count(*) from nation where n_regionkey is null)", _extra("n_nationkey", "nation"), _extra("n_name", "nation"),
    "(select count(*) from nation where n_regionkey not in (select r_regionkey from region))", "(select count(*) from customer where c_nationkey not in (select n_nationkey from nation))", _extra("c_nationkey", "customer", "c_mktsegment = 'BUILDING'"),
    "(select count(*) from orders where not o_totalprice between 1000 and 400000)", "(select count(*) from orders where o_orderstatus not in ('F', 'O'))", "(select count(*) from orders where not regexp_matches(o_orderpriority, '^[1-4]-'))", "(select count(*) from orders where o_custkey not in (select c_custkey from customer))",
    _extra("l_orderkey, l_linenumber", "lineitem"), "(select count(*) from lineitem where l_quantity < 2 and l_returnflag = 'R')", "(select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))",
    "(select count(*) from lineitem where l_linestatus = 'O' and l_suppkey not in (select s_suppkey from supplier))",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(" union all ".join(f"select {_quoted(c.name)} as name, '{c.kind}' as kind, {sql}::bigint as got, {sql} = {5 if c.kind == 'rows' else 0} as passed" for c, sql in zip(_DECLARED, _GOT, strict=True)))
def star_constraints(spark: SparkSession, d: str) -> DataFrame:
    """All declared constraints of the star schema: a scan for each table's own, one aggregate for each set of keys."""
    used = {"region": ["r_regionkey"], "nation": None, "customer": None, "orders": None, "lineitem": None, "supplier": ["s_suppkey"]}
    return constraints.evaluate({name: parquet(spark, d, name) for name in used}, _DECLARED)


# Versions and staged loads.

_OLD = "select c_custkey, c_name, c_acctbal from customer"
_NEW = "select c_custkey, case when c_custkey % 7 = 0 then upper(c_name) || '!' else c_name end as c_name, c_acctbal from customer where c_custkey % 11 <> 0 union all select c_custkey + 10000000, c_name, c_acctbal from customer where c_custkey % 13 = 0"
_BACK = f"select * from ({_NEW}) where c_custkey % 2 = 1 union all select * from ({_OLD}) where c_custkey % 2 = 0"


def _changes_sql(new: str, label: str) -> str:
    return f"""select coalesce(o.c_custkey, n.c_custkey) as c_custkey, '{label}' as since, case when o.c_custkey is null then 'inserted' when n.c_custkey is null then 'deleted' else 'updated' end as change
 from ({_OLD}) o full join ({new}) n on o.c_custkey = n.c_custkey where o.c_custkey is null or n.c_custkey is null or o.c_name <> n.c_name"""


@query(_changes_sql(_NEW, "published") + " union all " + _changes_sql(_BACK, "after rollback"))
def version_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a second version changed in the first one, and what of that is left after the even keys are rolled back."""
    store = versions.Store(spark, scratch(spark))
    c = parquet(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    first = store.publish({"customer": c, "nation": parquet(spark, d, "nation")})
    changed = c.where("c_custkey % 11 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")))
    added = c.where("c_custkey % 13 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    second = store.publish({"customer": changed.union(added)})
    third = store.rollback_range("customer", first, ["c_custkey"], F.col("c_custkey") % 2 == 0, None)
    one = lambda to, label: store.changes("customer", first, to, ["c_custkey"]).select("c_custkey", F.lit(label).alias("since"), "change")
    return one(second, "published").union(one(third, "after rollback"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def staged_load(spark: SparkSession, d: str) -> DataFrame:
    """All lines from a stage that was loaded in chunks."""
    stage = staging.Stage(spark, scratch(spark))
    stage.load(parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], size=1000, passes=2)
    return stage.rows()
