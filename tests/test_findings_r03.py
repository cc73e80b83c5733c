"""What the findings of round 3 showed."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import extract, fuzzy
from ledgerlark.operators import layout, resolve, staging
from ledgerlark.plans.registry import ORACLES, QUERIES
from ledgerlark.streaming import leases

#: A page whose text is cut within a reference, as some of sf0.1 are.
CUT = "<h1>a &lt; b</h1><ul><li>und&amp;&amp;&amp</li><li>x &lt y &copy &</li><li>&#x27;q&#x27</li></ul>"


def test_open_references_stay():
    assert extract.cells_of(CUT, ("li", "h1"), closed=True) == ["a < b", "und&&&amp", "x &lt y &copy &", "'q&#x27"]
    assert extract.cells_of("<li><script>a && b</script>&amp</li>", ("li",), closed=True) == ["a && b&amp"]
    assert extract.cells_of("<td>a &amp b</td>") == ["a & b"]


def _pages(spark, tmp_path):
    spark.createDataFrame([(1, CUT), (2, None), (3, "<li>one</li>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["html_cells", "pairs_adjacent"])
def test_cells_of_cut_pages(spark, tmp_path, name):
    con = _pages(spark, tmp_path)
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_job_has_more_steps_than_leave_together(spark, tmp_path, monkeypatch):
    """F8, F10: the processor takes rows, not a frame for each job, and its steps leave in arrays of a bounded length."""
    monkeypatch.setattr(leases, "TOGETHER", 3)
    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    rows = [(j, at(m), m, a, w) for j in range(4) for m, (a, w) in enumerate([("submit", None), ("claim", "a"), ("beat", "b"), ("beat", "a"), ("done", "a"), ("submit", None), ("claim", "b")])]
    spark.createDataFrame(rows, "job long, at timestamp, tie long, action string, worker string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job long, at timestamp, tie long, action string, worker string").parquet(f"{tmp_path}/in")
    plan = leases.decided(stream, "job", timedelta(minutes=10))
    assert "InPandas" not in plan._jdf.queryExecution().logical().toString()
    steps = leases.run(spark, stream, "job", timedelta(minutes=10), f"{tmp_path}/out")
    got = sorted((r["job"], r["step"], r["at"], r["granted"], r["until"]) for r in steps.where("action <> 'expire'").collect())
    until = [None, at(11), at(11), at(13), None, None, at(16)]
    assert got == [(j, m + 1, at(m), m != 2, until[m]) for j in range(4) for m in range(7)]


def test_many_chunks_are_few_files(spark, tmp_path, monkeypatch):
    """files and marks do not grow with the number of chunks, and a load still goes on where it stopped."""
    monkeypatch.setattr(staging, "RUNS", 4)
    rows = spark.range(2000).select("id", (F.col("id") % 7).alias("k"))
    stage = staging.Stage(spark, f"{tmp_path}/stage")
    put, n = stage._put, []

    def fails(name, value):
        n.append(name)
        if len(n) == 4:
            raise RuntimeError("the driver is gone")
        put(name, value)

    monkeypatch.setattr(stage, "_put", fails)
    with pytest.raises(RuntimeError):
        stage.load(rows, ["id"], size=10, passes=2)
    again = staging.Stage(spark, f"{tmp_path}/stage")
    kept = again.done()
    assert kept == list(range(50))
    assert again.load(rows, ["id"], size=10, passes=2) == list(range(50, 200))
    assert sorted(map(tuple, again.rows().collect())) == [(i, i % 7) for i in range(2000)]
    assert len([f for f in (tmp_path / "stage").iterdir() if f.name.startswith("done-")]) == 8


def test_requests_without_a_key_are_dealt_out(spark):
    """no task has all requests that lack an identifier."""
    requests = spark.range(4000).select(F.col("id").cast("int").alias("req_id"), F.when(F.col("id") % 50 == 0, F.col("id").cast("int")).alias("k"))
    table = spark.range(4000).select(F.col("id").alias("by"), (F.col("id") * 2).alias("v"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = resolve._look_up(requests, table, {"k": "by"})
        assert found.columns == ["req_id", "k", "v"]
        assert max(r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()) < 2000
        assert sorted(map(tuple, found.where("v is not null").collect())) == [(i, i, 2 * i) for i in range(0, 4000, 50)]
        assert found.count() == 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_close_names_need_no_pairs_of_the_scope(spark):
    """a name with a letter missing meets few rows, and loses none that could be its best; other names meet all."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abC #1ख") for _ in range(rng.randint(1, 7)))
    rows = [(i, word(), word() if i % 3 else None, i % 4, i % 2) for i in range(150)]
    names = [(i, rng.choice("ds"), word(), i % 5 == 0, i % 4, i % 2) for i in range(150)]
    r = spark.createDataFrame(rows, "id int, constituency string, constituency_hindi string, district_id long, state_id int")
    n = spark.createDataFrame(names, "rep int, scope string, asked_name string, local boolean, scope_district long, scope_state int")
    got = {tuple(x) for x in resolve._close(n, r).collect()}
    for rep, scope, name, local, district, state in names:
        for i, english, hindi, d, s in rows:
            value = hindi if local else english
            inside = d == district if scope == "d" else s == state
            assert not ((rep, i) in got and not inside)
            if inside and value and fuzzy.partial_ratio(name, value) > 100 - 100 / len(name) + 1e-9:
                assert (rep, i) in got, (name, value)
    asked = spark.range(300).select(F.col("id").cast("int").alias("rep"), F.lit("d").alias("scope"), F.format_string("Cstomer#%09d", "id").alias("asked_name"), F.lit(False).alias("local"), F.lit(1).cast("long").alias("scope_district"), F.lit(None).cast("int").alias("scope_state"))
    own = spark.range(300).select(F.col("id").cast("int").alias("id"), F.format_string("Customer#%09d", "id").alias("constituency"), F.lit(None).cast("string").alias("constituency_hindi"), F.lit(1).cast("long").alias("district_id"), F.lit(0).alias("state_id"))
    assert sorted(map(tuple, resolve._close(asked, own).collect())) == [(i, i) for i in range(300)]


def test_a_long_section_is_not_held(spark):
    """rows of a section leave while it is read, and go on over the ends of batches."""
    n = 3000
    line = F.col("id")
    text = F.when(line % 3 == 0, F.concat((line / 3 % 999 + 1).cast("int").cast("string"), F.lit(" - Name"))).when(line % 3 == 1, F.lit("Part"))
    frags = F.array_compact(F.array(F.when(text.isNotNull(), F.struct(F.lit(1.0).alias("x"), text.alias("text"))), F.struct(F.lit(90.0).alias("x"), F.concat(F.lit("e"), line.cast("string")).alias("text"))))
    lines = spark.range(3 * n).select(F.lit("d").alias("doc"), F.lit("s").alias("section"), (line / 100).cast("long").alias("page"), line.alias("line"), F.lit("h").alias("heading"), frags.alias("frags"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = layout.assemble_rows(lines, 50.0)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().logical().toString()
        got = sorted(map(tuple, found.collect()), key=lambda r: int(r[3].split()[0][1:]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == [("s", i % 999 + 1, "- Name Part" if got[0][2].startswith("-") else "Name Part", f"e{3 * i} e{3 * i + 1} e{3 * i + 2}", "h", 3 * i // 100) for i in range(n)]
