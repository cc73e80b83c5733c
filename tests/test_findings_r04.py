"""What the findings of round 4 showed."""

import duckdb
import numpy as np
import pytest

from ledgerlark.functions import extract
from ledgerlark.llm import hard_negatives
from ledgerlark.plans.registry import ORACLES, QUERIES
from tests.llm.test_search_and_repeats import mined

#: Pages with marks, open and closed references, a script and an unclosed table before the sheet; one without html.
PAGES = [
    (1, "https://a.example/x", "<h1>a &lt; b</h1><li>und&amp;&amp</li>"), (2, "https://b.example/y", None), (3, "http://c.example/", ""),
    (20_000_004, "https://d.example/z?q=1", "x \u0001 y \u0002 z<script>a && b</script><table><tr><td>one<td>two"),
]


def _against_sql(spark, tmp_path, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_marks_of_a_cut_are_texts():
    """what cuts a text at its labels is not what finds open references in html."""
    assert isinstance(extract._OPEN, str) and isinstance(extract._CLOSE, str)
    assert extract.cells_of("<li>und&amp;&amp</li>", ("li",), closed=True) == ["und&&amp"]


def test_parse_documents_of_odd_pages(spark, tmp_path):
    """F2."""
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    _against_sql(spark, tmp_path, "parse_documents", "pages")


def test_parse_sheets_of_odd_parts(spark, tmp_path):
    """both forms of a sheet, with long and repeated keys."""
    parts = [(1, "x", "Brand#1", "SMALL TIN"), (2, "one of four words", "Brand#23", "LARGE BRASS"), (60_000_001, "lace spring", "Brand#55", "PROMO"), (60_000_002, "one & two", "Brand#5", "ECONOMY"), (2, "again", "Brand#9", "TIN")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    _against_sql(spark, tmp_path, "parse_sheets", "part")


@pytest.mark.parametrize("most", [40, 1 << 24])
def test_blocks_are_read_once_for_a_group(spark, monkeypatch, most):
    """a block is not copied for each of the queries that visit it; squares of the larger numbers are over 2^53."""
    for name, value in {"BLOCK": 64, "LEAF": 8, "QUERIES": 5, "HELD": 4}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    put, visits = hard_negatives.settle, []

    def settled(df):
        if df.columns == ["anchor_id", "slot", "score", "vec_id"]:
            visits.append(df._jdf.queryExecution().optimizedPlan().toString())
        return put(df)

    monkeypatch.setattr(hard_negatives, "settle", settled)
    rng = np.random.default_rng(9)
    v = rng.integers(-most, most, (400, 128))
    v[rng.random(400) < 0.2] = v[0]
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in r]) for i, r in enumerate(v)]
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label long, v array<int>"))
    assert sorted(map(tuple, found.collect())) == mined(rows)
    assert visits and all("MapInArrow" in p and "Join" not in p for p in visits)
