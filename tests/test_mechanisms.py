"""Claims, logs, sequences, pages, constraints, versions and staged loads."""

import random
import shutil
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlark.errors import EngineError
from ledgerlark.operators import automaton, constraints, sequences, staging, versions
from ledgerlark.streaming import leases

T = datetime(2024, 1, 1)
LEASE = timedelta(minutes=10)


def at(minutes):
    return T + timedelta(minutes=minutes)


# Claims.


def test_decide():
    steps = [
        ("claim", "a", 0, False, "none"), ("submit", None, 1, True, "pending"), ("submit", None, 1, False, "pending"), ("claim", None, 2, False, "pending"), ("claim", "a", 2, True, "processing"), ("claim", "b", 12, False, "processing"),
        ("beat", "b", 12, False, "processing"), ("beat", "a", 12, True, "processing"), ("done", "a", 23, False, "processing"), ("claim", "b", 23, True, "processing"), ("fail", "a", 24, False, "processing"), ("done", "b", 33, True, "completed"),
        (None, "b", 34, False, "completed"), ("submit", None, 34, True, "pending"), ("claim", "c", 1, True, "processing"),
    ]
    job = leases.Job()
    for n, (action, worker, minutes, granted, status) in enumerate(steps):
        job, got = leases.decide(job, action, worker, at(minutes), LEASE)
        assert (got, job.status, job.steps) == (granted, status, n + 1), steps[n]
    assert (job.owner, job.until, job.claims) == ("c", at(44), 3)  # the last claim came late: it counts from the 34th minute


REQUESTS = "job long, at timestamp, tie long, action string, worker string"


def test_claims_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(1, 6), at(i * 2 + rng.random()), i, rng.choice(leases.ACTIONS), rng.choice(["a", "b", None])) for i in range(300)] + [(None, at(1), 1, "submit", None), (7, None, 2, "submit", None)]
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in ((0, 90), (90, 200), (200, 302)):
        spark.createDataFrame(rows[a:b], REQUESTS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(folder)
        steps = leases.run(spark, stream, "job", LEASE, sink, delay="1 minute")
    jobs, granted = {}, []
    for job, t, tie, action, worker in rows[:300]:
        jobs[job], ok = leases.decide(jobs.get(job, leases.Job()), action, worker, t, LEASE)
        granted.append((job, tie, ok))
    got = steps.where("action <> 'expire'").count()
    assert got == 300
    # Timers free jobs whose leases are over; what is granted is the same as without them.
    assert sorted(r["granted"] for r in steps.where("action <> 'expire'").collect()) == sorted(ok for _, _, ok in granted)
    now = max(r[1] for r in rows if r[1])
    want = sorted((j, "pending" if s.status == "processing" and s.until < now else s.status, None if s.status == "processing" and s.until < now else s.owner, s.claims) for j, s in jobs.items())
    assert sorted(map(tuple, leases.owners(steps, "job", F.lit(now)).collect())) == want
    assert steps.where("action = 'expire'").count() > 0


# The log.


def folded(rows):
    state, out = {}, []
    for job, t, tie, status in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = state.get(job, "none")
        ok = (before, status) in automaton.LEGAL
        state[job] = status if ok else before
        out.append((job, tie, before, state[job], ok))
    return sorted(out)


@pytest.mark.parametrize("ranges", [1, 7])
def test_log(spark, ranges, monkeypatch):
    monkeypatch.setattr(automaton, "CHUNK", 8)
    rng = random.Random(4)
    # One job has most of the steps, so that it is cut between runs and ranges.
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), at(rng.randint(0, 400)), i, rng.choice([*automaton.STATES[1:], "odd", None])) for i in range(600)]
    made = spark.createDataFrame([*rows, (None, at(1), 9, "pending")], "job long, at timestamp, tie long, status string")
    steps = automaton.checked(made, "job", "at", "tie", "status", ranges=ranges)
    assert sorted((r["job"], r["tie"], r["before"], r["after"], r["legal"]) for r in steps.collect()) == folded(rows)
    early = {}
    for job, t, tie, status in sorted(rows, key=lambda r: (r[1], r[2])):
        if t <= at(200):
            before = early.get(job, "none")
            early[job] = status if (before, status) in automaton.LEGAL else before
    assert {r["job"]: r["state"] for r in automaton.state_at(steps, "job", "at", "tie", F.lit(at(200))).collect()} == early
    assert automaton.checked(made.limit(0), "job", "at", "tie", "status").count() == 0


# Sequences and pages.


def test_sequence_is_dense_however_it_is_dealt(spark):
    rows = spark.createDataFrame([(i * 37 % 501, i) for i in range(501)], "v long, i long")
    want = [(i * 37 % 501, i) for i in range(501)]
    want = {i: n + 41 for n, (_, i) in enumerate(sorted(want))}
    for ranges in (1, 200):
        done, last = sequences.next_values(rows, ["v", "i"], "id", 40, ranges)
        assert {r["i"]: r["id"] for r in done.collect()} == want and last == 541
    more, last = sequences.next_values(rows.limit(0), ["v"], "id", 541)
    assert (more.count(), last, more.columns) == (0, 541, ["v", "i", "id"])
    with pytest.raises(EngineError):
        sequences.ordered(rows.withColumnRenamed("v", "_row"), ["i"])


def test_pages(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(500)], "v long, i long")
    done = sequences.ordered(rows, [F.desc("v"), F.col("i")], 9)
    want = sorted(((i // 3, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    for number in (1, 4, 10, 11):
        assert sorted(map(tuple, sequences.page(done, number, 50).collect())) == sorted(want[(number - 1) * 50 : number * 50])
    plan = sequences.page(done, 5, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "Exchange" not in plan and "Sort" not in plan
    key, seen = (1 << 40, -1), []
    while got := sequences.after(rows, [("v", False), ("i", True)], key, 120).collect():
        seen += [tuple(r) for r in got]
        key = seen[-1]
    assert seen == want
    with pytest.raises(EngineError):
        sequences.page(done, 0, 50)


# Constraints.


def test_constraints(spark):
    parent = spark.createDataFrame([(1, "x"), (2, "y")], "id long, code string")
    child = spark.createDataFrame([(1, 1, "A-1", 5, None), (2, 3, "bad", 50, "q"), (2, None, None, None, "q"), (4, 2, "B-2", 7, "q"), (None, 3, "C-3", 1, "r")], "id long, pid long, code string, n long, k string")
    declared = [
        *constraints.not_null("child", "code", "k"), *constraints.in_range("child", "n", 2, 20), *constraints.matches("child", "code", "^[A-Z]-[0-9]$"), *constraints.one_of("child", "k", "q"), *constraints.unique("child", "id"),
        *constraints.unique("child", "k", where="n > 5"), *constraints.reference("child", "pid", "parent", "id"), *constraints.reference("child", "pid", "parent", "id", where="n < 10"), *constraints.row_count("child", 1, 4), *constraints.in_range("child", "n", 1, None, where="k = 'q'"),
    ]
    tables = {"parent": parent, "child": child}
    got = {r["name"]: (r["got"], r["passed"]) for r in constraints.evaluate(tables, declared).collect()}
    assert got == {
        "child.code not_null": (1, False), "child.k not_null": (1, False), "child.n range 2..20": (2, False), "child.code matches ^[A-Z]-[0-9]$": (1, False), "child.k one_of q": (1, False), "child.id unique": (1, False),
        "child.k unique where n > 5": (1, False), "child.pid reference parent.id": (2, False), "child.pid reference parent.id where n < 10": (1, False), "child rows 1..4": (5, False), "child.n range 1..None where k = 'q'": (0, True),
    }
    assert constraints.breaking(tables, declared[2]).count() == 2 and constraints.breaking(tables, declared[5]).count() == 2 and constraints.breaking(tables, declared[7]).count() == 2
    with pytest.raises(EngineError, match="child rows"):
        constraints.enforce(tables, declared)
    with pytest.raises(EngineError, match="nowhere"):
        constraints.evaluate(tables, constraints.not_null("nowhere", "x"))
    assert constraints.catalogue(declared)[0] == ("child rows 1..4", "child", "rows", "", "")


def test_constraints_scan_a_table_once(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    own = [*constraints.not_null("orders", *orders.columns), *constraints.in_range("orders", "o_totalprice", 0, None), *constraints.row_count("orders", 1)]
    plan = constraints.evaluate({"orders": orders}, own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and plan.count("Location") == 1


# Versions.


@pytest.fixture
def root():
    folder = tempfile.mkdtemp(prefix="versions-")
    yield folder
    shutil.rmtree(folder)


def test_versions(spark, root):
    store = versions.Store(spark, root)
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, name string")
    b = spark.createDataFrame([(1, 10)], "id long, n long")
    assert store.versions() == [] and store.latest() == 0
    assert store.publish({"a": a, "b": b}, apply=False) == 1 and store.versions() == []
    assert store.publish({"a": a, "b": b}, note="first") == 1

    # The second table fails while it is written: neither is there.
    broken = b.withColumn("n", F.expr("raise_error('lost')").cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.publish({"a": a.where("id = 1"), "b": broken})
    assert store.versions() == [1] and store.read("a").count() == 3 and store.sweep() == []

    # A check that sees both tables together.
    matched = lambda t: [constraints.evaluate(t, constraints.reference("b", "id", "a", "id")).select(F.col("name").alias("check"), "got", F.lit(0).cast("long").alias("want"), "passed")]
    with pytest.raises(EngineError, match="GATE_FAILED"):
        store.publish({"a": a.where("id > 1")}, matched)
    changed = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "id long, name string")
    assert store.publish({"a": changed}, matched) == 2
    assert store.manifest(2)["parent"] == 1 and store.manifest(2)["tables"]["b"] == store.manifest(1)["tables"]["b"]
    assert sorted(map(tuple, store.changes("a", 1, 2, ["id"]).collect())) == [(2, "updated"), (3, "deleted"), (4, "inserted")]

    # Two publishers from one parent: the second one fails.
    with pytest.raises(EngineError, match="LOST_RACE"):
        store.publish({"a": a}, parent=1)
    assert store.versions() == [1, 2] and store.sweep() == []

    with pytest.raises(EngineError, match="ROLLBACK_GUARD"):
        store.rollback_range("a", 1, ["id"], F.col("id") > 3, expect=2)
    assert store.rollback_range("a", 1, ["id"], F.col("id") > 2, expect=1) == 3
    assert sorted(map(tuple, store.read("a").collect())) == [(1, "x"), (2, "Y"), (3, "z")]
    assert store.rollback(1) == 4 and store.changes("a", 1, 4, ["id"]).count() == 0
    with pytest.raises(EngineError, match="NO_VERSION"):
        store.manifest(9)
    with pytest.raises(EngineError, match="NO_TABLE"):
        store.read("c")


# Staged loads.


def test_stage_goes_on(spark, root, monkeypatch):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    stage = staging.Stage(spark, root)
    put, n = stage._put, []

    def fails(name, value):
        n.append(name)
        if len(n) == 5:
            raise RuntimeError("the driver is gone")
        put(name, value)

    monkeypatch.setattr(stage, "_put", fails)
    with pytest.raises(RuntimeError):
        stage.load(rows, ["id"], size=100, passes=3)
    with pytest.raises(EngineError, match="NOT_STAGED"):
        stage.rows()
    again = staging.Stage(spark, root)
    kept = again.done()
    assert kept == [0, 1, 2]
    assert again.load(rows, ["id"], size=100, passes=3) == list(range(3, 10))
    assert sorted(map(tuple, again.rows().collect())) == [(i, i % 7) for i in range(1000)]
    assert again.load(rows, ["id"]) == []
    with pytest.raises(EngineError, match="OTHER_LOAD"):
        again.load(rows.withColumn("k", F.lit("x")), ["id"])
    again.drop()
    empty = staging.Stage(spark, root)
    empty.load(rows.limit(0), ["id"])
    assert empty.rows().count() == 0
