"""Fuzzy resolution against all scores of all rows in the scope."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import fuzzy
from ledgerlark.operators import resolve
from ledgerlark.plans import queries


def test_no_score_is_above_its_bound(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé लखन😀") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(600)] + [(None, "a"), ("aab", "ab"), ("abc", "abc"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.bound(F.col("a"), F.col("b"), fuzzy.bag(F.col("a")), fuzzy.bag(F.col("b"))).alias("most"))
    tight = 0
    for a, b, most in df.collect():
        score = fuzzy.partial_ratio(a or "", b or "")
        assert a is None or score <= most + 1e-9, (a, b, score, most)
        tight += a is not None and score == most
    assert tight > 100


@pytest.mark.parametrize("first", [1, 12])
def test_resolution_is_that_of_all_scores(spark, small, monkeypatch, first):
    monkeypatch.setattr(resolve, "FIRST", first)
    rng = random.Random(6)
    c, d, s = queries.constituencies(spark, small), queries.districts(spark, small), queries.states(spark, small)
    names = ["Nor{}th Plain {}", "{}Hill Side{}", "River{} Bend {}", "Old {}Fort{}", "Lake {} View{}"]
    rows = [r.asDict() for r in c.collect()]
    for r in rows:
        r["id"], r["constituency"], r["constituency_hindi"] = int(r["id"]), rng.choice(names).format(rng.choice(["", "e", "x"]), rng.choice(["", "East", "West", "a"])), None
    c = spark.createDataFrame([tuple(r[k] for k in c.columns) for r in rows], c.withColumn("id", F.col("id").cast("int")).schema)
    asked = []
    for i in range(120):
        r = rng.choice(rows)
        name = list(r["constituency"])
        del name[rng.randrange(len(name))]
        scope = ("d", "s", None)[i % 3]
        asked.append((i, "".join(name) + rng.choice(["", "q"]), str(r["state_id"]) if scope else None, None, r["lgd_district_code"] if scope == "d" else None, None, None, None))
    asked.append((120, "Zzzz", "1", None, None, None, None, None))
    requests = spark.createDataFrame(asked, "req_id int, name string, state_code string, state_name string, district_lgd_code string, district_name string, ac_number int, constituency_id int")
    got = {r["req_id"]: r for r in resolve.resolve(requests, c, s, d).collect()}
    seen = set()
    for i, name, state, _, district, *_ in asked:
        low = name.casefold()
        tokens = sorted(low.split(), key=len)
        pool = [r for r in rows if (state is None or str(r["state_id"]) == state) and (district is None or r["lgd_district_code"] == district) and (state is not None or tokens[-1] in r["constituency"].casefold())]
        exact = [r["id"] for r in pool if " ".join(r["constituency"].split()).casefold() == " ".join(low.split())]
        if exact or not pool or (state is None and len(pool) > resolve.UNSCOPED_CAP) or sum(len(t) == len(tokens[-1]) for t in tokens) > 1:
            continue
        top = sorted(((-fuzzy.partial_ratio(name.strip(), r["constituency"]), r["id"], r["state_id"]) for r in pool))[: resolve.TOP]
        best = -top[0][0]
        tied, plausible = [x[1] for x in top if -x[0] == best], {x[2] for x in top if -x[0] >= resolve.THRESHOLD}
        status = resolve.NOT_FOUND if best < resolve.THRESHOLD else resolve.AMBIGUOUS if len(tied) > 1 or (state is None and len(plausible) > 1) else resolve.RESOLVED
        assert (got[i]["status"], round(got[i]["score"], 6)) == (status, round(best, 6)), (name, got[i], top)
        if status == resolve.RESOLVED:
            assert got[i]["match_id"] == top[0][1]
        elif len(tied) > 1 and best >= resolve.THRESHOLD:
            assert got[i]["candidates"] == tied
        seen.add((status, state is None))
    assert {(resolve.AMBIGUOUS, False), (resolve.RESOLVED, False), (resolve.NOT_FOUND, False), (resolve.AMBIGUOUS, True)} <= seen
