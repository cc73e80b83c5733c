"""Queries of whole families of small operators, over literals made from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions import extract, text, validate
from ledgerlark.operators import gates, geo, layout, load, records, report, requests, resolve
from ledgerlark.plans.queries import ORACLES, constituencies, districts, query, states, voters
from ledgerlark.sources.tables import parquet
from ledgerlark.streaming import jobs

# Gates.


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 5 or l_quantity > 45")
def range_gate(spark: SparkSession, d: str) -> DataFrame:
    return gates.outside(parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 5, 45)


@query("select 'o_custkey' as column, count(*) filter (where o_orderkey % 7 = 0) as n from orders union all select 'o_orderstatus', count(*) filter (where o_orderkey % 11 = 0) from orders union all select 'o_orderkey', 0 from (select 1)")
def null_gate(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return gates.null_counts(o, ["o_custkey", "o_orderstatus", "o_orderkey"])


@query("select s_suppkey, s_suppkey % 29 as code from supplier where s_suppkey % 29 not in (select n_nationkey from nation)")
def alias_targets(spark: SparkSession, d: str) -> DataFrame:
    s = parquet(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 29).alias("code"))
    return gates.missing_targets(s, parquet(spark, d, "nation"), {"code": "n_nationkey"}).select("s_suppkey", "code")


@query("select 'kept' as part, count(*) as n from customer where coalesce(nullif(c_nationkey, 5) not in (1, 2), true) union all select 'excluded', count(*) from customer where c_nationkey in (1, 2)")
def exclusion_partition(spark: SparkSession, d: str) -> DataFrame:
    """A null code is excluded by nothing."""
    c = parquet(spark, d, "customer").select(F.nullif("c_nationkey", F.lit(5)).alias("code"))
    kept, out = gates.partition(c, "code", [1, 2])
    n = F.count(F.lit(1)).alias("n")
    return kept.agg(n).select(F.lit("kept").alias("part"), "n").union(out.agg(n).select(F.lit("excluded").alias("part"), "n"))


@query("select 'o_orderstatus' as counter, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2")
def multi_counters(spark: SparkSession, d: str) -> DataFrame:
    return gates.counters(parquet(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select count(*) as n_rows, count(*) filter (where trim(coalesce(nullif(p_name, 'hot gear'), '')) = '') as n_blank, count(*) filter (where regexp_matches(nullif(p_name, 'hot gear'), '(?i)\\bsmall\\b')) as n_matching from part")
def blank_and_matching(spark: SparkSession, d: str) -> DataFrame:
    return gates.text_counts(parquet(spark, d, "part").select(F.nullif("p_name", F.lit("hot gear")).alias("name")), "name", r"(?i)\bsmall\b")


@query("select count(distinct (p_brand, p_type)) as n_all, count(distinct (p_brand, p_type)) filter (where p_size > 40) as n_meeting from part")
def distinct_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return gates.distinct_pairs(parquet(spark, d, "part"), ["p_brand", "p_type"], F.col("p_size") > 40)


@query("select c_nationkey, count(*) as n from customer group by 1 order by n desc, c_nationkey limit 10")
def counts_by_size(spark: SparkSession, d: str) -> DataFrame:
    """The ten greatest groups."""
    return report.counts_descending(parquet(spark, d, "customer"), "c_nationkey").limit(10)


@query("select code from (select distinct (p_size % 37)::varchar as code from part) order by code::int limit 12")
def numeric_text_order(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve codes by number; by text 10 would come before 2."""
    codes = parquet(spark, d, "part").select((F.col("p_size") % 37).cast("string").alias("code")).distinct()
    return codes.orderBy(*records.numeric_order("code")).limit(12)


@query("select count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_suppkey % 3 = 0)")
def valid_reference_count(spark: SparkSession, d: str) -> DataFrame:
    s = parquet(spark, d, "supplier").where("s_suppkey % 3 = 0")
    return gates.valid_references(parquet(spark, d, "lineitem").select("l_suppkey"), s, "l_suppkey", "s_suppkey")


@query("select o_orderkey, lower(o_orderstatus) as o_orderstatus, o_orderstatus as old_o_orderstatus from orders where o_orderkey % 9 = 0")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    after = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")))
    return gates.changed_rows(o, after, ["o_orderkey"])


@query("select * from (select 'counts' as section, 'customer' as item, count(*)::varchar as value from customer union all select 'counts', 'orders', count(*)::varchar from orders union all select 'blank names', 'part', (count(*)::varchar || ', 0, 0') from part union all select 'states', r_regionkey::varchar, case when count(c_custkey) > 0 then count(c_custkey)::varchar || ', VERIFIED' else '0, UNEXPECTED' end from region left join (nation join customer on n_nationkey = c_nationkey) on r_regionkey = n_regionkey group by r_regionkey)")
def sectioned_report(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    counts = parquet(spark, d, "customer").agg(n).select(F.lit("customer").alias("t"), "n").union(parquet(spark, d, "orders").agg(n).select(F.lit("orders").alias("t"), "n"))
    blank = gates.text_counts(parquet(spark, d, "part"), "p_name", "^[0-9]+$").select(F.lit("part").alias("t"), "*")
    rows = constituencies(spark, d).select(F.col("state_id").cast("string").alias("state_code"))
    return gates.report({"counts": counts, "blank names": blank, "states": gates.coverage(states(spark, d), rows, "state_code", {}, {}, set())})


# Loads.


@query(
    """with v as (select o_orderkey as id, case when o_orderkey % 3 = 0 then 'E' || (o_custkey % 40)::varchar when o_orderkey % 3 = 1 then '' end as epic, case when o_orderkey % 50 = 0 then -1 else o_custkey % 20 + 1 end as ac from orders),
 r as (select *, row_number() over (partition by epic, ac order by id) as k from v where ac <> -1 and epic <> '')
 select v.id, case when v.ac = -1 then 'INVALID_CONSTITUENCY' when r.k > 1 or r.epic = 'E7' then 'EPIC_ALREADY_EXISTS' else 'saved' end as outcome, case when v.ac <> -1 and not coalesce(r.k > 1 or r.epic = 'E7', false) then c_name end as constituency_name from v left join r using (id) left join customer on c_custkey = v.ac"""
)
def save_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records to be saved: of no known constituency, repeated in the batch, stored already, or new."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    epic = F.when(k % 3 == 0, F.concat(F.lit("E"), (F.col("o_custkey") % 40).cast("string"))).when(k % 3 == 1, F.lit(""))
    area = F.when(k % 50 == 0, F.lit(-1)).otherwise(F.col("o_custkey") % 20 + 1).cast("long")
    new = parquet(spark, d, "orders").select(k.alias("id"), epic.alias("epic"), area.alias("assembly_constituency_id"), none.alias("assembly_constituency_name"), none.alias("district"), F.lit(None).cast("int").alias("district_id"), F.lit(None).cast("int").alias("mandal_id"))
    stored = spark.range(1, 21).select(F.lit("E7").alias("epic"), F.col("id").alias("assembly_constituency_id"))
    saved, refused = load.save(new, stored, constituencies(spark, d), districts(spark, d))
    return saved.select("id", F.lit("saved").alias("outcome"), F.col("assembly_constituency_name").alias("constituency_name")).union(refused.select("id", F.col("code").alias("outcome"), none.alias("constituency_name")))


@query("select s_suppkey, coalesce(n.n_nationkey, a.n_nationkey)::bigint as code, count(coalesce(n.n_nationkey, a.n_nationkey)) over (partition by coalesce(n.n_nationkey, a.n_nationkey)) as used from (select s_suppkey, case when s_suppkey <= 20 then 'NATION_' || s_suppkey::varchar when s_suppkey <= 22 then 'OLD_' || s_suppkey::varchar else 'NOWHERE' end as name from supplier) s left join nation n on n.n_name = s.name left join nation a on s.name in ('OLD_21', 'OLD_22') and a.n_name = 'NATION_' || replace(s.name, 'OLD_', '')")
def official_names(spark: SparkSession, d: str) -> DataFrame:
    """Legacy names to codes: an equal name, an alias, or none; used tells whether a code is taken once."""
    k = F.col("s_suppkey")
    name = F.when(k <= 20, F.concat(F.lit("NATION_"), k.cast("string"))).when(k <= 22, F.concat(F.lit("OLD_"), k.cast("string"))).otherwise(F.lit("NOWHERE"))
    legacy = parquet(spark, d, "supplier").select("s_suppkey", name.alias("name"))
    aliases = spark.createDataFrame([("OLD_21", "NATION_21"), ("OLD_22", "NATION_22")], "alias string, name string")
    return load.official(legacy, parquet(spark, d, "nation"), "name", "n_name", "n_nationkey", aliases).select("s_suppkey", F.col("code").cast("long").alias("code"), "used")


@query("select c_custkey, case when c_nationkey <> 3 then c_nationkey end as n_nationkey, case when c_nationkey <> 3 then n_name end as n_name from customer left join nation on c_nationkey = n_nationkey")
def coded_rows(spark: SparkSession, d: str) -> DataFrame:
    """A null code matches nothing, and a row without a code has no text of it."""
    c = parquet(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("n_nationkey"), F.lit("stale").alias("n_name"))
    return load.coded(c, parquet(spark, d, "nation"), "n_nationkey", ["n_name"]).select("c_custkey", "n_nationkey", "n_name")


@query("select c_custkey as constituency_id, n_regionkey::varchar as state_code, r_name as state_name_en, (c_custkey % 97 + 1)::int as ac_number, c_name as constituency, n_nationkey::varchar as district_lgd_code, n_name as district_name_en from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def candidate_briefs(spark: SparkSession, d: str) -> DataFrame:
    rows = geo.candidates(constituencies(spark, d), states(spark, d), districts(spark, d))
    return rows.select(geo.brief().alias("b")).select("b.*").drop("constituency_hindi")


@query("select id::varchar as id, case when id % 5 <> 0 then (id % 50)::varchar end as user_id, name, assembly_constituency_id, district_id from (select o_orderkey as id, o_orderpriority as name, o_custkey as assembly_constituency_id, c_nationkey as district_id from orders join customer on o_custkey = c_custkey)")
def serialised_records(spark: SparkSession, d: str) -> DataFrame:
    v = voters(spark, d).withColumn("user_id", F.when(F.col("id") % 5 != 0, F.col("user_id")))
    return records.serialise(v).select("id", "user_id", "name", "assembly_constituency_id", "district_id")


# Texts.

_TEXTS = "(select p_partkey as k, p_name as name, p_brand as brand, p_type as type from part)"


@query(
    rf"""select k, regexp_extract(label, '^\s*(\d{{1,3}})\s*[-–—.:)]?\s*(\D.*)$', 1)::int as number, name as bare, case when k % 3 = 0 then 'SC' when k % 3 = 1 then 'ST' end as reserved, upper(replace(name, '&', ' AND ')) as key,
 (select w from (select unnest(string_split(name, ' ')) as w, generate_subscripts(string_split(name, ' '), 1) as i) where length(w) >= 3 order by length(w) desc, i limit 1) as longest, array_to_string(string_split(name || ' ' || lower(type), ' ')[1:4], ' ') as four,
 'ABC' || lpad((k % 10000000)::varchar, 7, '0') as epic, '9' || lpad((k % 1000000000)::varchar, 9, '0') as mobile, name || ' x' as unmarked
 from (select *, (k % 900 + 1)::varchar || ' - ' || name as label from {_TEXTS})"""
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Names with numbers, marks, brackets and markdown put around them, and what the functions take off again."""
    k, name = F.col("p_partkey"), F.col("p_name")
    label = F.concat((k % 900 + 1).cast("string"), F.lit(" - "), name)
    mark = F.when(k % 3 == 0, F.lit(" (sc) –")).when(k % 3 == 1, F.lit("(ST).")).otherwise(F.lit(" -"))
    dirty = F.concat(F.lit(" abc"), F.lpad((k % 10000000).cast("string"), 7, "0"), F.lit("./-"))
    mobile = F.concat(F.lit("9"), F.lpad((k % 1000000000).cast("string"), 9, "0"))
    phone = F.when(k % 3 == 0, F.concat(F.lit("+91 "), mobile)).when(k % 3 == 1, F.concat(F.substring(mobile, 1, 5), F.lit(" "), F.substring(mobile, 6, 5))).otherwise(F.concat(F.lit("call "), mobile, F.lit(" now")))
    return parquet(spark, d, "part").select(
        k.alias("k"), text.number_in_name(label).alias("number"), text.without_reservation(F.concat(name, mark)).alias("bare"), text.reservation(F.concat(name, mark)).alias("reserved"), text.match_key(name).alias("key"), text.longest_token(name).alias("longest"),
        text.first_words(F.concat(name, F.lit("  "), F.lower("p_type"))).alias("four"), text.normal_epic(dirty).alias("epic"), text.normal_mobile(phone).alias("mobile"), text.without_markdown(F.concat(F.lit("**"), name, F.lit("** ~~gone~~x`code`"))).alias("unmarked"),
    )


@query("select p_partkey, case when p_size % 4 = 0 then 'उत्तर प्रदेश' when p_size % 4 = 1 then p_name end as state, p_size % 4 <> 3 as local, case when p_size % 3 = 0 then p_name else p_brand end as shown, p_name as district from part")
def state_and_label_functions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size")
    raw = F.when(k % 4 == 0, F.lit("u.p.")).when(k % 4 == 1, F.concat(F.lit(" "), F.col("p_name"), F.lit("123 ."))).when(k % 4 == 2, F.lit("—12"))
    script = F.when(k % 4 == 3, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" लखनऊ")))
    local = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.lit(""))
    return parquet(spark, d, "part").select("p_partkey", text.normal_state(raw).alias("state"), text.has_devanagari(script).alias("local"), text.local_or_english(local, F.col("p_brand")).alias("shown"), text.strip_prefix(F.concat(F.lit("जिला : "), F.col("p_name")), text.DISTRICT_LABEL).alias("district"))


_CELLS_SQL = r"""(select page_id, (i - 1)::int as place, trim(replace(replace(replace(replace(replace(regexp_replace(cells[i], '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&')) as cell
 from (select page_id, regexp_extract_all(html, '(?s)<(?:li|h1)>(.*?)</(?:li|h1)>', 1) as cells from pages), unnest(generate_series(1, len(cells))) as t(i))"""
ORACLES["html_cells"] = f"select * from {_CELLS_SQL}"
ORACLES["pairs_adjacent"] = f"select page_id, place, cell as label, value from (select *, lead(cell) over (partition by page_id order by place) as value, lead(place) over (partition by page_id order by place) as following from {_CELLS_SQL}) where following is not null"
ORACLES["parse_documents"] = """select page_id, 'Reader ' || page_id || ' of ' || host as name, 'ABC' || lpad((page_id % 10000000)::varchar, 7, '0') as epic, '97' || lpad((page_id % 100000000)::varchar, 8, '0') as mobile, page_id::varchar as serial_number,
 '7 - ' || host as part_number_and_name, 'AC ' || host as assembly_constituency, 'D ' || host as district, 'उत्तर प्रदेश' as state, '12 ' || host || ' Ward ' || page_id as address
 from (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages)"""


# Sheets.


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """A sheet made of each part: its fields before a table, or in the table's cells."""
    k = F.col("p_partkey")
    number = F.lpad((k % 10000000).cast("string"), 7, "0")
    lines = [
        F.concat(F.lit("निर्वाचक का नाम: "), F.col("p_name")), F.concat(F.lit("ईपीआईसी: ABC"), number), F.concat(F.lit("पता: 12 "), F.col("p_name"), F.lit("\nWard "), F.col("p_brand")), F.concat(F.lit("क्रम संख्या: "), k.cast("string")),
        F.concat(F.lit("भाग संख्या एवं नाम: 45 - "), F.col("p_type")), F.concat(F.lit("विधानसभा निर्वाचन क्षेत्र का नाम: "), F.col("p_brand")), F.lit("राज्य का नाम: UP"), F.concat(F.lit("मोबाइल नंबर: 98"), F.lpad((k % 100000000).cast("string"), 8, "0")),
    ]
    sheet = F.concat_ws("\n", *lines)
    pair = F.concat(F.lit("<td>जिला</td><td>जिला: "), F.col("p_brand"), F.lit("</td>"))
    phone = F.concat(F.lit("<td>मोबाइल नंबर</td><td>+91 98"), F.lpad((k % 100000000).cast("string"), 8, "0"), F.lit("</td>"))
    in_cells = F.concat(F.lit("<table><tr><td>"), F.replace(sheet, F.lit("\n"), F.lit("<br>")), F.lit("</td>"), pair, phone, F.lit("</tr></table>"))
    # A small file is one task; each row is some milliseconds of work.
    parts = parquet(spark, d, "part").repartition(spark.sparkContext.defaultParallelism)
    return parts.select("p_partkey", F.when(k % 2 == 0, F.concat(sheet, F.lit("<table><tr>"), pair, F.lit("</tr></table>"))).otherwise(in_cells).alias("sheet"))


@query(
    """select p_partkey, p_name as name, 'ABC' || lpad((p_partkey % 10000000)::varchar, 7, '0') as epic, '98' || lpad((p_partkey % 100000000)::varchar, 8, '0') as mobile, p_partkey::varchar as serial_number, '45 - ' || p_type as part_number_and_name, p_brand as assembly_constituency,
 p_brand as district, 'उत्तर प्रदेश' as state, '12 ' || p_name || ' Ward ' || p_brand as address, case when length('12 ' || p_name || ' Ward ' || p_brand) > 20 then 0.75 else 0.6 end::double as sure from part"""
)
def parse_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The nine fields of sheets in either form."""
    parsed = extract.parse(_sheets(spark, d), "sheet")
    return parsed.select("p_partkey", *[F.col(f"parsed.{f}.value").alias(f) for f in extract.FIELDS], F.col("parsed.address.confidence").alias("sure"))


@query("select p_partkey, p_partkey % 2 = 0 as parsed, case when p_partkey % 2 = 0 then p_name end as voter_name, case when p_partkey % 2 = 0 then p_partkey::varchar end as serial_number, case when p_partkey % 2 = 0 then '' end as state, case when p_partkey % 2 = 0 then 0.99 else 0.0 end::double as sure from part")
def reply_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Replies with fences and words around them, and ones that are no JSON."""
    k = F.col("p_partkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit('Here: ```json\n{"voter_name": " '), F.col("p_name"), F.lit(' ", "serial_number": '), k.cast("string"), F.lit(', "state": null}\n``` ok'))).otherwise(F.lit("no reply"))
    reply = parquet(spark, d, "part").select("p_partkey", validate.parse_reply(raw).alias("r"))
    fields = requests.reply_fields(F.col("r"), {"name": "voter_name"})
    return reply.select("p_partkey", F.col("r").isNotNull().alias("parsed"), "r.voter_name", "r.serial_number", "r.state", fields["name"]["confidence"].alias("sure"))


# Requests.


@query("select c_custkey, list_filter([case when c_custkey % 4 = 0 then 'username has fewer than 5 characters' end, case when c_custkey % 3 = 0 then 'mobile has not 10 digits' end, case when c_custkey % 5 = 0 then 'role is unknown' end, case when c_custkey % 5 = 1 and c_custkey % 2 = 0 then 'district_id is required' end], lambda x: x is not null) as found from customer")
def registrations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.lit(None).cast("int")
    rows = parquet(spark, d, "customer").select(
        k, F.col("c_name").alias("first_name"), F.when(k % 4 == 0, F.lit("abc")).otherwise(F.lit("abcdef")).alias("username"), F.lit("secret1").alias("password"), F.when(k % 3 == 0, F.lit("123")).otherwise(F.lit("9876543210")).alias("mobile"),
        F.when(k % 5 == 0, F.lit("king")).when(k % 5 == 1, F.lit("district")).otherwise(F.lit("superadmin")).alias("role"), none.alias("mandal_id"), F.when(k % 2 == 1, F.lit(3)).otherwise(F.lit(0)).alias("district_id"), none.alias("constituency_id"), none.alias("booth_id"),
    )
    return rows.select("c_custkey", requests.registration_issues().alias("found"))


@query("select p_partkey, case when p_size % 3 = 0 then 'INVALID_FILE_TYPE' when p_size % 4 = 0 then 'FILE_TOO_LARGE' end as issue, case when p_size % 5 = 1 then '2022' when p_size % 5 = 2 then '2019' else '2008' end as version from part")
def uploads_and_sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size")
    kind = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit("text/html"))).otherwise(F.lit("image/png"))
    size = F.when(k % 4 == 0, F.lit(requests.UPLOAD_BYTES + 1)).otherwise(F.lit(requests.UPLOAD_BYTES))
    return parquet(spark, d, "part").select("p_partkey", requests.upload_issue(kind, size).alias("issue"), requests.source_tag((k % 5).cast("string"), {"1": "2022", "2": "2019"}, "2008").alias("version"))


# Resolution, after the choice.


@query(
    """select p_partkey, case when s = 0 then 'Name' else 'raw' end as value, case when s = 0 then 0.99 else 0.3 end::double as confidence, case when s = 1 then 'weak_match' when s = 2 then 'unresolved_unverified' when s = 3 then 'unresolved_not_found' else 'resolved' end as resolution_status,
 case when s = 1 then 'Name' when s = 2 then 'Other' end as suggested_value, case when s = 0 then p_partkey end as constituency_id, case when s = 0 then 'लखनऊ' end as district, case s when 1 then 'CONSTITUENCY_CONFIRMATION_REQUIRED' when 2 then 'AMBIGUOUS_CONSTITUENCY' when 3 then 'INVALID_CONSTITUENCY' end as gate from (select p_partkey, p_partkey % 4 as s from part)"""
)
def after_resolution(spark: SparkSession, d: str) -> DataFrame:
    s, none = F.col("p_partkey") % 4, F.lit(None).cast("string")
    status = F.when(s <= 1, F.lit(resolve.RESOLVED)).when(s == 2, F.lit(resolve.UNVERIFIED)).otherwise(F.lit(resolve.NOT_FOUND))
    method = F.when(s == 1, F.lit("fuzzy")).when(s == 0, F.lit("exact")).when(s == 2, F.lit("identifier"))
    field = resolve.confirm(F.lit("raw"), status, method, F.lit("Name"), F.lit("Other"), F.col("p_partkey"))
    district = resolve.fill_district(none, F.lit(0.0), status, method, F.lit("ज़िला: लखनऊ"))
    rows = parquet(spark, d, "part").select("p_partkey", field.alias("f"), district["value"].alias("district"), resolve.save_gate(status, method).alias("gate"))
    return rows.select("p_partkey", "f.value", "f.confidence", "f.resolution_status", "f.suggested_value", "f.constituency_id", "district", "gate")


@query("select c_custkey as req_id, 'resolved' as status, c_custkey as match_id, c_name as constituency, null::varchar as district from customer union all select -c_custkey - 1, 'unresolved_ambiguous', null, null, null from customer")
def resolve_by_state_names(spark: SparkSession, d: str) -> DataFrame:
    """A state by its name, another's by an alias; and names that two rows have, in no scope."""
    c = constituencies(spark, d).withColumn("id", F.col("id").cast("int"))
    twin = c.withColumns({"id": F.col("id") + 10_000_000, "state_id": (F.col("state_id") + 1) % 5, "district_id": F.lit(None).cast("long")})
    s, none = states(spark, d), F.lit(None)
    aliases = s.select(F.lit("state").alias("kind"), "state_code", none.cast("string").alias("ac_number"), F.concat(F.lit("Old "), F.col("state_name_en")).alias("alias"))
    named = c.join(s.select("state_id", "state_name_en"), "state_id")
    request = lambda key, state: named.select(key.cast("int").alias("req_id"), F.upper("constituency").alias("name"), none.cast("string").alias("state_code"), state.alias("state_name"), none.cast("string").alias("district_lgd_code"), none.cast("string").alias("district_name"), none.cast("int").alias("ac_number"), none.cast("int").alias("constituency_id"))
    state = F.when(F.col("id") % 2 == 0, F.lower("state_name_en")).otherwise(F.concat(F.lit(" OLD  "), F.col("state_name_en")))
    found = resolve.resolve(request(F.col("id"), state).union(request(-F.col("id") - 1, none.cast("string"))), c.unionByName(twin), s, districts(spark, d), aliases)
    names = requests.names_only(found, c, districts(spark, d))
    return found.join(names, "req_id").select(F.col("req_id").cast("long").alias("req_id"), "status", F.col("match_id").cast("long").alias("match_id"), "constituency", "district")


@query(
    """select event_id, case event_id % 4 when 0 then props when 1 then props when 2 then '```' || props else props || '``` and more' end as cleaned, case when event_id % 4 <= 1 then (props::json ->> 'k')::int end as k from events"""
)
def client_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies in a json fence, bare, and with fences that the client does not take for one; the latter two are no JSON."""
    k, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(k == 0, F.concat(F.lit("  ```json\n"), p, F.lit("\n```\n"))).when(k == 1, F.concat(F.lit(" "), p)).when(k == 2, F.concat(F.lit("```"), p)).otherwise(F.concat(p, F.lit("``` and more")))
    cleaned = text.client_json(raw)
    return parquet(spark, d, "events").select("event_id", cleaned.alias("cleaned"), F.when(k <= 1, F.from_json(cleaned, "k int")["k"]).alias("k"))


@query("select event_id, case event_type when 'view' then 'processing' when 'error' then 'failed' when 'signup' then 'pending' else 'completed' end as status, case when event_type = 'error' then 'lost ' || event_id end as error, case when event_type in ('click', 'purchase') then props end as data from events")
def job_views(spark: SparkSession, d: str) -> DataFrame:
    """What a client is told of each job: its error if it has failed, its result if it is done."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "processing").when(kind == "error", "failed").when(kind == "signup", "pending").otherwise("completed")
    e = parquet(spark, d, "events").select("event_id", status.alias("status"), "props", F.concat(F.lit("lost "), F.col("event_id").cast("string")).alias("why"))
    return e.select("event_id", jobs.view(F.col("status"), F.col("props"), F.col("why")).alias("v")).select("event_id", "v.*")


@query("select p_partkey, case when p_partkey % 3 = 0 then 'first' when p_partkey % 3 = 1 then 'retry' when p_size > 25 then 'retry' else 'first' end as chosen from part")
def retry_choice(spark: SparkSession, d: str) -> DataFrame:
    """A retry that cannot be read leaves the first reply; one that can be is taken, with issues or without."""
    k, parsed = F.col("p_partkey") % 3, F.col("p_size") > 25
    retry = F.when((k == 1) | ((k == 2) & parsed), F.lit("retry"))
    issues = F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("an issue")))
    return parquet(spark, d, "part").select("p_partkey", validate.after_retry(F.lit("first"), retry, issues).alias("chosen"))


# Layout.


def _order(spark: SparkSession, d: str) -> DataFrame:
    """Pages of an order of delimitation: a document for each region, 40 of its customers on a page."""
    c = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(parquet(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    order = Window.partitionBy("r_regionkey").orderBy("n_nationkey", "c_custkey")
    c = c.select("r_regionkey", "r_name", "n_nationkey", "n_name", "c_custkey", "c_name", "c_mktsegment").withColumn("rn", F.row_number().over(order)).withColumn("before", F.lag("n_nationkey").over(order))
    frag = lambda x, t: F.struct(F.lit(x).cast("double").alias("x"), t.alias("text"))
    line = lambda at, *frags: F.struct(at.cast("long").alias("line"), F.array(*frags).alias("frags"))
    number = (F.col("rn") - 1) % 999 + 1
    name = F.concat(number.cast("string"), F.lit(" – "), F.col("c_name"), F.when(F.col("c_custkey") % 5 == 0, F.lit(" (sc)")).otherwise(F.lit("")))
    at = (F.col("rn") - 1) % 40 * 3 + 10
    own = F.array(F.when(F.col("before").isNull() | (F.col("before") != F.col("n_nationkey")), line(at, frag(50, F.concat(F.lit("3 - DISTRICT : "), F.col("n_name"), F.lit("."))))), line(at + 1, frag(10, name), frag(200, F.col("c_mktsegment"))), line(at + 2, frag(200, F.lit("and others"))))
    rows = c.select(F.col("r_regionkey").cast("string").alias("doc"), F.floor((F.col("rn") - 1) / 40).alias("page"), F.explode(F.array_compact(own)).alias("l")).select("doc", "page", "l.*")
    heads = c.groupBy("r_regionkey", "r_name").agg(F.max("rn").alias("n"))
    first = F.array(line(F.lit(0), frag(90, F.lit("SCHEDULE – IV"))), line(F.lit(1), frag(90, F.col("r_name"))), line(F.lit(2), frag(60, F.lit("PART A – ASSEMBLY CONSTITUENCIES"))), line(F.lit(3), frag(10, F.lit("Sl. No. & Name")), frag(200, F.lit("Extent"))))
    end = F.array(line(F.lit(1000), frag(60, F.lit("PART B – PARLIAMENTARY CONSTITUENCIES"))), line(F.lit(1001), frag(10, F.lit("1 - Ignored")), frag(200, F.lit("x"))))
    doc = F.col("r_regionkey").cast("string").alias("doc")
    return rows.union(heads.select(doc, F.lit(0).cast("long").alias("page"), F.explode(first).alias("l")).select("doc", "page", "l.*")).union(heads.select(doc, F.floor((F.col("n") - 1) / 40).alias("page"), F.explode(end).alias("l")).select("doc", "page", "l.*"))


@query("select upper(r_name) as state_name, n_name as district, ((rn - 1) % 999 + 1)::int as ac_number, c_name as constituency, case when c_custkey % 5 = 0 then 'SC' else '' end as reservation, c_mktsegment || ' and others' as extent, (rn - 1) // 40 + 1 as page from (select *, row_number() over (partition by r_regionkey order by n_nationkey, c_custkey) as rn from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)")
def layout_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sections, part A, columns, headings carried forward, rows and their continuations, of whole documents."""
    return layout.delimitation(_order(spark, d))


# The report.

_TABLE_SQL = """(select n_regionkey::varchar as state_code, (rn + rn // 50 - case when c_custkey % 60 = 7 then 1 else 0 end)::bigint as ac_number, case when c_custkey % 40 = 3 then ' ' else c_name end as constituency, case when c_custkey % 3 = 0 then 'नाम' end as constituency_hindi,
 n_name as heading, case when n_nationkey % 5 in (1, 2, 3) then n_nationkey::varchar end as district_code, case n_nationkey % 5 when 0 then 'needs_review' when 3 then 'mapped' when 4 then 'no_district_in_source' else 'exact' end as confidence,
 c_mktsegment || case when c_custkey % 4 = 0 then ' of another District' else ' districts' end as extent, case c_custkey % 5 when 0 then 'SC' when 1 then 'ST' else '' end as reservation
 from (select *, row_number() over (partition by n_regionkey order by c_custkey) + case when n_regionkey = 2 then 9 else 0 end as rn from customer join nation on c_nationkey = n_nationkey))"""
_REASONS = {("0", "NATION 0"): "split in two", ("1", "NATION 5"): "renamed"}


def _constituency_table(spark: SparkSession, d: str) -> DataFrame:
    c = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rn = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("c_custkey")) + F.when(F.col("n_regionkey") == 2, 9).otherwise(0)
    k, n = F.col("c_custkey"), F.col("n_nationkey") % 5
    confidence = F.when(n == 0, "needs_review").when(n == 3, "mapped").when(n == 4, "no_district_in_source").otherwise("exact")
    return c.withColumn("rn", rn).select(
        F.col("n_regionkey").cast("string").alias("state_code"), (F.col("rn") + F.floor(F.col("rn") / 50) - F.when(k % 60 == 7, 1).otherwise(0)).cast("long").alias("ac_number"), F.when(k % 40 == 3, " ").otherwise(F.col("c_name")).alias("constituency"), F.when(k % 3 == 0, "नाम").alias("constituency_hindi"),
        F.col("n_name").alias("heading"), F.when(n.between(1, 3), F.col("n_nationkey").cast("string")).alias("district_code"), confidence.alias("confidence"), F.concat("c_mktsegment", F.when(k % 4 == 0, " of another District").otherwise(" districts")).alias("extent"),
        F.when(k % 5 == 0, "SC").when(k % 5 == 1, "ST").otherwise("").alias("reservation"),
    )


@query(
    f"""with t as materialized {_TABLE_SQL}, s as (select state_code, count(*) as n, min(ac_number) as low, max(ac_number) as high, count(*) filter (regexp_matches(extent, '\\b(district|District|DISTRICT)\\b')) as crossing from t group by 1),
 h as (select state_code, heading, count(*) filter (confidence in ('exact', 'mapped')) as found, count(*) filter (confidence = 'needs_review') as unmatched from t group by all),
 g as (select state_code, ac_number, lag(ac_number) over (partition by state_code order by ac_number) as before from (select distinct state_code, ac_number from t)),
 u as (select state_code, ac_number, count(*) as n from t group by all having count(*) > 1),
 v as (select r_regionkey::varchar as state_code, coalesce(n, 0) as n, case when n > 0 and r_regionkey = 1 then 'UNRESOLVED (2022)' else 'VERIFIED' end as status from region left join s on s.state_code = r_regionkey::varchar)
 select 1 as section, 0::bigint as place, 'rows' as item, count(*)::varchar as value from t union all select 1, 0, 'expected', '2000' union all select 1, 0, 'shortfall', (2000 - count(*))::varchar from t
 union all select 2, state_code::int, state_code, n || case when state_code = '0' then ', 300, ' || case when n = 300 then 'OK' else 'DIFFERS' end else ', not scheduled' end from s
 union all select 3, 0, 'duplicates', count(*)::varchar from u union all select 3, state_code::int, state_code || '/' || ac_number, n::varchar from u
 union all select 4, state_code::int * 1000000 + before + 1, state_code || ' missing', (before + 1) || '..' || (ac_number - 1) from g where ac_number - before > 1 union all select 4, state_code::int, state_code || ' numbers run', low || '..' || high from s where low <> 1
 union all select 5, 0, 'blank names', count(*)::varchar from t where trim(constituency) = '' union all select 5, 0, 'longest name', (select length(constituency) || ', ' || constituency from t order by length(constituency) desc, constituency desc limit 1)
 union all select 6, 0, c, count(confidence)::varchar from (values ('exact'), ('mapped'), ('needs_review'), ('no_district_in_source')) k(c) left join t on confidence = c group by c
 union all select 6, 0, 'headings', count(*)::varchar from h union all select 6, 0, 'headings with a district', count(*)::varchar from h where found > 0 union all select 6, 0, 'districts referred to', count(distinct (state_code, district_code)) || ' of 25' from t where district_code is not null union all select 6, 0, 'aliases', '4'
 union all select 7, state_code::int, state_code || ' ' || heading, unmatched || ', ' || case when (state_code, heading) in (('0', 'NATION_0')) then 'split in two' when (state_code, heading) in (('1', 'NATION_5')) then 'renamed' else 'not reviewed' end from h where unmatched > 0
 union all select 8, 0, 'extents that name a district', coalesce(sum(crossing), 0)::bigint::varchar from s union all select 8, state_code::int, state_code, crossing::varchar from s where crossing > 0
 union all select 9, 0, 'local names', count(constituency_hindi) || ' of ' || count(*) from t
 union all select 10, state_code::int, state_code, n || ', ' || status from v union all select 10, 0, 'verified', count(*)::varchar from v where status = 'VERIFIED' union all select 10, 0, 'unresolved', count(*)::varchar from v where status <> 'VERIFIED' union all select 10, 0, 'without an assembly', '0'
 union all select 11, 0, 'One 32', 'a seat of no territory' union all select 12, (reservation = '')::int, case when reservation = '' then '(general)' else reservation end, count(*)::varchar from t group by reservation"""
)
def constituency_report(spark: SparkSession, d: str) -> DataFrame:
    """The twelve sections, of a table with planted gaps, repeats and blanks."""
    known = report.Known(expected=2000, scheduled={"0": 300}, not_current={"1": "2022"}, districts=25, aliases=4, reasons=_REASONS, absent={"One 32": "a seat of no territory"})
    return report.constituency_report(_constituency_table(spark, d), states(spark, d).select("state_code"), known)
