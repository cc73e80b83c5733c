import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.errors import EngineError
from ledgerlark.functions import extract, fuzzy, text, validate, vision
from ledgerlark.operators import gates, geo, layout, load, publish, resolve
from ledgerlark.plans import queries
from ledgerlark.sources import pdf, tables
from ledgerlark.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def places(spark):
    states = spark.createDataFrame([(1, "1", "One", None), (2, "2", "Two", None)], "state_id int, state_code string, state_name_en string, state_name_hi string")
    districts = spark.createDataFrame([(10, "Dten", None, 7, 1, "10"), (11, "Delev", None, 8, 1, "11"), (20, "Dtwen", None, 9, 2, "20")], "district_id int, district_name_en string, district_name_hi string, mandala_id int, state_id int, lgd_district_code string")
    names = [(1, "Alpha North", 10, 1, 1), (2, "Alpha South", 10, 1, 2), (3, "Beta", 11, 1, 3), (4, "Beta", 20, 2, 1), (5, "Gamma Cantonment", 20, 2, 2)]
    constituencies = spark.createDataFrame([(i, n, None, d, s, a, str(d)) for i, n, d, s, a in names], "id int, constituency string, constituency_hindi string, district_id int, state_id int, ac_number int, lgd_district_code string")
    aliases = spark.createDataFrame([("constituency", "2", "2", "Gamma Cantt"), ("state", "1", None, "Uno")], "kind string, state_code string, ac_number string, alias string")
    return states, districts, constituencies, aliases


#: name, state code, district code, number, id -> status, method, match, candidates
RESOLVE = [
    (("beta", None, None, None, None), ("unresolved_ambiguous", "exact", None, [3, 4])),
    (("Beta", "1", None, None, None), ("resolved", "exact", 3, [])),
    (("Beta", None, None, None, 4), ("resolved", "identifier", 4, [])),
    (("Beta", "1", "20", None, None), ("unresolved_scope_conflict", None, None, [])),
    (("3 - Beta", "1", None, None, None), ("resolved", "exact", 3, [])),
    (("1 - Beta", "1", None, None, None), ("unresolved_scope_conflict", None, None, [])),
    (("3 - Beta", "1", None, 4, None), ("unresolved_scope_conflict", None, None, [])),
    (("Beta", "1", None, 9, None), ("unresolved_scope_conflict", None, None, [])),
    (("Alpha", "1", None, None, None), ("unresolved_ambiguous", "fuzzy", None, [1, 2])),
    (("Alpa North", "1", None, None, None), ("resolved", "fuzzy", 1, [])),
    (("Alpa North", "1", None, None, 1), ("resolved", "identifier", 1, [])),
    (("Qqqq", "1", None, None, None), ("unresolved_not_found", "fuzzy", None, [])),
    (("zzzz", None, None, None, None), ("unresolved_not_found", None, None, [])),
    (("ab", None, None, None, None), ("unresolved_scope_required", None, None, [])),
    (("Gamma Cantt", "2", None, None, None), ("resolved", "exact", 5, [])),
    (("बीटा", "1", None, None, None), ("unresolved_reference_unavailable", "fuzzy", None, [])),
    (("बीटा", "1", None, None, 3), ("unresolved_unverified", "identifier", None, [3])),
    (("Beta", "99", None, None, None), ("unresolved_ambiguous", "exact", None, [3, 4])),
    (("", None, None, None, None), ("unresolved_not_found", None, None, [])),
]


def test_resolve(spark, places):
    states, districts, constituencies, aliases = places
    requests = spark.createDataFrame([(i, n, s, None, d, None, a, c) for i, ((n, s, d, a, c), _) in enumerate(RESOLVE)], "req_id int, name string, state_code string, state_name string, district_lgd_code string, district_name string, ac_number int, constituency_id int")
    got = {r["req_id"]: (r["status"], r["method"], r["match_id"], r["candidates"]) for r in resolve.resolve(requests, constituencies, states, districts, aliases).collect()}
    assert got == {i: want for i, (_, want) in enumerate(RESOLVE)}


def test_after_resolution(spark):
    df = spark.createDataFrame([("resolved", "exact"), ("resolved", "fuzzy"), ("unresolved_not_found", None), ("unresolved_ambiguous", "exact")], "status string, method string")
    got = [tuple(r) for r in df.select(resolve.save_gate(F.col("status"), F.col("method"))).collect()]
    assert got == [(None,), ("CONSTITUENCY_CONFIRMATION_REQUIRED",), ("INVALID_CONSTITUENCY",), ("AMBIGUOUS_CONSTITUENCY",)]
    field = df.select(resolve.confirm(F.lit("raw"), F.col("status"), F.col("method"), F.lit("Name"), F.lit(None).cast("string")).alias("f")).select("f.*").collect()
    assert [tuple(f) for f in field][:2] == [("Name", 0.99, "raw", "resolved", None), ("raw", 0.3, "raw", "weak_match", "Name")]


def test_missing_parent(places):
    states, districts, _, _ = places
    with pytest.raises(EngineError) as e:
        geo.districts(districts, states, state_id=99)
    assert e.value.code == "STATE_NOT_FOUND"


SHEET = "निर्वाचक का नाम: राम कुमार\nईपीआईसी: ABC1234567\nपता: 12 मुख्य मार्ग, लखनऊ शहर\nक्रम संख्या: 123\nभाग संख्या एवं नाम: 45 - प्राथमिक विद्यालय\nविधानसभा निर्वाचन क्षेत्र का नाम: 174 - लखनऊ मध्य\nराज्य का नाम: UP\nमोबाइल नंबर: 98765 43210"
FIELDS = {"name": ("राम कुमार", 0.75), "epic": ("ABC1234567", 0.8), "address": ("12 मुख्य मार्ग, लखनऊ शहर", 0.75), "serial_number": ("123", 0.97), "part_number_and_name": ("45 - प्राथमिक विद्यालय", 0.75), "assembly_constituency": ("174 - लखनऊ मध्य", 0.6), "state": ("उत्तर प्रदेश", 0.99), "mobile": ("9876543210", 0.8), "district": (None, 0.0)}


def test_parse(spark):
    cells = "<table><tr><td>" + SHEET.replace("\n", "<br>") + "</td><td>जिला</td><td>जिला: लखनऊ</td><td>मोबाइल नंबर</td><td>+91 98765 43211</td></tr></table>"
    both = SHEET + "<table><td>निर्वाचक का नाम: और कोई</td></table>"
    docs = spark.createDataFrame([(1, SHEET), (2, cells), (3, both), (4, None), (5, "")], "i int, t string")
    got = {r["i"]: {k: (v["value"], v["confidence"]) for k, v in r["parsed"].asDict(True).items()} for r in extract.parse(docs, "t").collect()}
    assert got[1] == FIELDS
    assert got[2] == FIELDS | {"district": ("लखनऊ", 0.75), "mobile": ("9876543211", 0.8)}
    assert got[3]["name"] == ("राम कुमार", 0.75)
    assert set(got[4].values()) == set(got[5].values()) == {(None, 0.0)}


def test_parse_reads_long_pages_whole(spark):
    cells = "<table>" + "<td>one</td>" * 20_000 + "<td>" + SHEET.replace("\n", "<br>") + "</td><td>जिला</td><td>जिला: लखनऊ</td></table>"
    docs = spark.createDataFrame([(1, "x y z\n" * 40_000 + SHEET), (2, cells), (3, "विधानसभा x " * 20_000 + "\n" + SHEET)], "i int, t string")
    got = {r["i"]: {k: (v["value"], v["confidence"]) for k, v in r["parsed"].asDict(True).items()} for r in extract.parse(docs, "t").collect()}
    assert got[1] == got[3] == FIELDS
    assert got[2] == FIELDS | {"district": ("लखनऊ", 0.75), "mobile": (None, 0.0)}


def test_cells():
    assert extract.cells_of("<td>a<br>  b &amp; c</td><th>d</th><td>lost<td>kept</td>") == ["a\nb & c", "d", "kept"]


def test_text_functions(spark):
    df = spark.createDataFrame([("xg.0739631.",), ("MCG 0982678",), ("XG/073963",), (None,)], "s string")
    assert [r[0] for r in df.select(text.normal_epic(F.col("s"))).collect()] == ["XG/0739631", "MCG0982678", None, None]
    names = spark.createDataFrame([(x,) for x in ["174 - लखनऊ मध्य", "174X", "1234 X", "12", "12-34", None]], "s string")
    got = [tuple(r) for r in names.select(text.number_in_name(F.col("s")), text.name_without_number(F.col("s"))).collect()]
    assert got == [(174, "लखनऊ मध्य"), (174, "X"), (None, "1234 X"), (None, "12"), (12, "-34"), (None, "")]
    norm = spark.createDataFrame([("  Straße  X ",), (None,)], "s string").select(text.norm_text(F.col("s"))).collect()
    assert [r[0] for r in norm] == ["strasse x", ""]
    mixed = spark.createDataFrame([("Foo (SC).", "Tom & Jerry", "9 the longest one")], "a string, b string, c string")
    assert tuple(mixed.select(text.reservation(F.col("a")), text.without_reservation(F.col("a")), text.match_key(F.col("b")), text.longest_token(F.col("c"))).first()) == ("SC", "Foo", "TOM AND JERRY", "longest")
    phones = spark.createDataFrame([("+91 98765 43210",), ("98765 43210",), ("12345",)], "s string")
    assert [r[0] for r in phones.select(text.normal_mobile(F.col("s"))).collect()] == ["9876543210", "9876543210", None]


def test_partial_ratio():
    assert fuzzy.partial_ratio("Alpa North", "Alpha North") == 90.0
    assert fuzzy.partial_ratio("Alpa North", "Alpha South") == 70.0
    assert fuzzy.partial_ratio("Alpha", "Alpha North") == 100.0
    assert fuzzy.partial_ratio("", "") == 100.0 and fuzzy.partial_ratio("", "a") == 0.0


def test_validation(spark):
    replies = ["nothing", '```json\n{"voter_name": null, "epic_number": 12, "serial_number": "12", "extra": 1}\n```', 'so: {"address": "Part 4", "mobile_number": "123", "serial_number": "a b c d e f"} ok', '{"mobile_number": "+91 98765 43210"}']
    df = spark.createDataFrame([(r,) for r in replies], "raw string").withColumn("reply", validate.parse_reply(F.col("raw")))
    df = df.withColumn("issues", validate.issues(F.col("reply")))
    got = [(r["issues"], r["s"]) for r in df.select("issues", validate.score(F.col("reply"), F.col("issues")).alias("s")).collect()]
    assert got == [([validate.BAD_JSON], -10), ([validate.ISSUES[1]], 10), ([validate.ISSUES[3], validate.ISSUES[4], validate.ISSUES[5]], 0), ([], 60)]


def test_gates(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (70_000,), (None,)], "k long")
    assert rows(gates.gaps(df, "k")) == [(3, 69_999, 69_997)]
    before, after = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, v string"), spark.createDataFrame([(1, "a"), (2, "x")], "i int, v string")
    assert sorted(map(repr, rows(gates.snapshot_difference(before, after).selectExpr("i", "coalesce(v, '-') v", "side")))) == sorted(map(repr, [(1, "a", "before"), (2, "-", "before"), (2, "x", "after")]))
    assert rows(gates.changed_rows(before.where("i = 2"), after, ["i"])) == [(2, "x", None)]
    good = gates.check("rows", before.agg(F.count(F.lit(1))), 3)
    assert rows(gates.enforce([good])) == [("rows", 3, 3, True)]
    with pytest.raises(EngineError):
        gates.enforce([good, gates.check("none", before.agg(F.count(F.lit(1))), 0)])


def test_loads(spark):
    target = spark.createDataFrame([(1, None), (2, "x")], "ac int, epic string")
    stage = spark.createDataFrame([(1, None), (2, "y"), (None, "z")], "ac int, epic string")
    new, refused = load.split_inserts(target, stage, ["ac", "epic"])
    assert rows(refused.fillna("-")) == [(1, "-")] and new.count() == 2
    once = load.insert_absent(target, stage, ["ac", "epic"], null_safe=True)
    assert once.count() == load.insert_absent(once, stage, ["ac", "epic"], null_safe=True).count() == 4
    assert load.insert_absent(target, stage, ["ac", "epic"]).count() == 5
    assert rows(load.upsert(target, spark.createDataFrame([(2, "n"), (3, "m")], "ac int, epic string"), ["ac"]).fillna("-")) == [(1, "-"), (2, "n"), (3, "m")]


def test_layout(spark):
    fragments = spark.createDataFrame([(0, 0, 10.0, 700.0, "1 Foo"), (0, 1, 200.0, 701.5, "wards"), (0, 2, 10.0, 690.0, "Bar"), (0, 3, 10.0, 680.0, "2 Baz")], "page long, place long, x double, y double, text string")
    lines = layout.cluster_lines(fragments).withColumns({"section": F.lit("S"), "heading": F.lit("H")})
    got = rows(layout.assemble_rows(lines, layout.boundary(10.0, 200.0)))
    assert got == [("S", 1, "Foo Bar", "wards", "H", 0), ("S", 2, "Baz", "", "H", 0)]


def lines_of(spark, *lines):
    """(page, line, fragments) as lines of one document."""
    return spark.createDataFrame([("d", p, n, frags) for p, n, frags in lines], "doc string, page long, line long, frags array<struct<x:double,text:string>>")


def test_layout_rows_and_continuations(spark):
    numbered = [(0, i, [(10.0, f"{n} - {name}"), (200.0, "x")]) for i, (n, name) in enumerate([(1, "Foo"), (3, "Bar"), (4, "Baz")])]
    lines = lines_of(spark, *numbered).withColumns({"section": F.lit("S"), "heading": F.lit("H")})
    assert [r["number"] for r in layout.assemble_rows(lines, 100.0).orderBy("number").collect()] == [1, 3, 4]  # a gap in the numbers
    wrapped = lines_of(spark, (0, 0, [(10.0, "1"), (200.0, "a")]), (0, 1, [(10.0, "Long Name")]), (0, 2, [(10.0, "ward 7 of the old town")]), (0, 3, [(10.0, "5"), (200.0, "b")]), (1, 0, [(10.0, "2 : Next (St) –")]))
    got = rows(layout.assemble_rows(wrapped.withColumns({"section": F.lit("S"), "heading": F.lit("H")}), 100.0).select("number", "name", "extent", "page"))
    assert got == [(1, "Long Name", "a ward 7 of the old town 5 b", 0), (2, "Next (St) –", "", 1)]


def test_layout_of_a_document(spark):
    head = [(0, 0, [(90.0, "SCHEDULE - II")]), (0, 1, [(90.0, "Bihar")]), (1, 0, [(60.0, "PART B - PARLIAMENTARY")]), (1, 1, [(60.0, "TABLE - A ASSEMBLY CONSTITUENCIES")]), (1, 2, [(50.0, "DISTRICT : Gaya (contd.)")])]
    body = [(1, 3, [(10.0, "1 - Foo (SC)"), (210.0, "x")]), (2, 0, [(12.0, "2 - Bar"), (200.0, "y")]), (2, 1, [(10.0, "3 - Baz"), (200.0, "z")]), (2, 2, [(10.0, "17")]), (3, 0, [(10.0, "4 - Qux"), (200.0, "w")]), (3, 1, [(60.0, "PART B – PARLIAMENTARY CONSTITUENCIES")]), (3, 2, [(10.0, "9 - No"), (200.0, "v")]), (4, 0, [(90.0, "SCHEDULE - III")]), (4, 1, [(90.0, "PART A - ASSEMBLY CONSTITUENCIES")])]
    lines = lines_of(spark, *head, *body)
    part = layout.in_part_a(layout.in_sections(layout.with_text(lines)))
    edge = layout.column_edge(part).select("name_left", "extent_left", "edge").first()
    assert tuple(edge) == (10.0, 200.0, 10.0 + 0.62 * 190)
    got = [tuple(r) for r in layout.delimitation(lines).orderBy("ac_number").collect()]
    assert got == [("BIHAR", "Gaya", n, name, r, x, p) for n, name, r, x, p in [(1, "Foo", "SC", "x", 2), (2, "Bar", "", "y", 3), (3, "Baz", "", "z", 3), (4, "Qux", "", "w", 4)]]


def test_reservations(spark):
    names = ["Foo (sc) –", "Foo-Bar (ST).", ". Foo -", "Foo’s"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.reservation(F.col("n")), text.without_reservation(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("SC", "Foo"), ("ST", "Foo-Bar"), (None, "Foo"), (None, "Foo's")]


def test_repeats_in_a_stage(spark):
    target, stage = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "z"), (2, "y"), (None, "p"), (None, "q")], "k int, v string")
    assert rows(load.insert_absent(target, stage, ["k"], order=["v"]).fillna(-1)) == [(-1, "p"), (-1, "q"), (1, "a"), (2, "y")]
    assert rows(load.insert_absent(target, stage, ["k"], null_safe=True, order=["v"]).fillna(-1)) == [(-1, "p"), (1, "a"), (2, "y")]
    new, refused = load.split_inserts(target, stage, ["k"], ["v"])
    assert rows(new.fillna(-1)) == [(-1, "p"), (2, "y")] and rows(refused.fillna(-1)) == [(-1, "q"), (1, "x"), (2, "z")]


def test_publish(spark, tmp_path):
    df, name = spark.range(5), str(tmp_path / "t")
    size = lambda want: lambda rows: [gates.check("rows", rows.agg(F.count(F.lit(1))), want)]
    assert rows(publish.publish(df, name, size(5), apply=False)) == [("rows", 5, 5, True)] and not any(tmp_path.iterdir())
    with pytest.raises(EngineError):
        publish.publish(df, name, size(4))
    assert not any(tmp_path.iterdir())
    assert publish.publish(df, name, size(5)).count() == 5 and publish.exists(spark, name)
    with pytest.raises(EngineError) as e:
        publish.publish(df, name, size(5))
    assert e.value.code == "ALREADY_PUBLISHED" and len(list(tmp_path.iterdir())) == 1


def test_work_that_takes_too_long(spark):
    import time

    df = spark.createDataFrame([("a", "0"), ("b", "5")], "id string, image_path string").selectExpr("*", "'pending' status", "cast(null as string) result", "cast(null as string) error_message")
    got = {r["id"]: (r["status"], r["error_message"]) for r in jobs.process(df, lambda v: time.sleep(float(v)) or v, seconds=0.5).collect()}
    assert got == {"a": ("completed", None), "b": ("failed", "no result within 0.5 seconds")}


def test_regions_of_images(spark):
    image = np.arange(20 * 10 * 3, dtype=np.uint8).reshape(20, 10, 3)
    df = spark.createDataFrame([("a", 20, 10, 3, bytearray(image.tobytes())), ("b", 0, 0, 3, None)], "key string, height int, width int, nChannels int, data binary")
    got = {r["key"]: (r["height"], r["width"], r["data"]) for r in vision.regions(df).collect()}
    want = vision.stack([image[0:5, 0:6], image[5:11]])
    assert want.shape == (11, 10, 3) and (want[5:] == image[5:11]).all()
    assert got == {"a": (11, 10, bytearray(want.tobytes())), "b": (0, 0, None)}


def test_aliases_and_marks(spark, tmp_path, places):
    got = {(r["kind"], r["alias"]): r["targets"] for r in resolve.alias_sets(places[3]).collect()}
    assert got == {("constituency", "gamma cantt"): ["2/2"], ("state", "uno"): ["1"]}
    (tmp_path / "bad.json").write_text('{"no": "list"')
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        tables.json_pages(spark, str(tmp_path / "bad.json")).collect()


def test_pdf(spark, tmp_path):
    stream = zlib.compress(b"BT 1 0 0 1 10 700 Tm (Caf\\351 \\(x\\)) Tj 0 -12 Td [(a) -20 (b)] TJ ET")
    out = io.BytesIO()
    out.write(b"%PDF-1.4\n1 0 obj <</Type /Pages /Kids [2 0 R]>> endobj\n2 0 obj <</Type /Page /Parent 1 0 R /Contents 3 0 R>> endobj\n3 0 obj <</Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj\n")
    (tmp_path / "a.pdf").write_bytes(out.getvalue())
    assert [tuple(r)[1:] for r in pdf.pdf_fragments(spark, str(tmp_path / "a.pdf")).collect()] == [(0, 0, 10.0, 700.0, "Café (x)"), (0, 1, 10.0, 688.0, "ab")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿kind,alias\n state ,Uno\n", encoding="utf-8")
    from pyspark.sql.types import StringType, StructField, StructType

    got = tables.csv(spark, str(tmp_path / "a.csv"), StructType([StructField("kind", StringType()), StructField("alias", StringType())]))
    assert rows(got) == [("state", "Uno")]
    (tmp_path / "p.json").write_text('[[[700.5, [[1, "a"], [2, "b"]]], [690, []]]]')
    pages = tables.json_pages(spark, str(tmp_path / "p.json")).collect()
    assert [(r["page"], r["y"], [tuple(f) for f in r["frags"]]) for r in pages] == [(0, 700.5, [(1.0, "a"), (2.0, "b")]), (0, 690.0, [])]
    tables.write_export(spark.createDataFrame([("a", None)], "Name string, EPIC string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text(encoding="utf-8") == "﻿Name,EPIC\na,\n"


def test_jobs(spark):
    df = spark.createDataFrame([("b", "pending", 1, "ok", None, None), ("a", "pending", 1, "bad", None, None), ("c", "failed", 0, "x", None, None)], "id string, status string, created_at long, image_path string, result string, error_message string")
    assert jobs.claim(df).first()["id"] == "a"

    def work(path):
        if path == "bad":
            raise ValueError("no image")
        return path.upper()

    got = {r["id"]: (r["status"], r["result"], r["error_message"]) for r in jobs.process(df.where("status = 'pending'"), work).collect()}
    assert got == {"a": ("failed", None, "no image"), "b": ("completed", "OK", None)}


def test_vision():
    flat, noisy = np.full((20, 10, 3), 9, np.uint8), np.random.default_rng(0).integers(0, 255, (20, 10, 3), dtype=np.uint8)
    assert vision.laplacian_variance(flat) == 0.0 < vision.BLURRED < vision.laplacian_variance(noisy)
    assert [vision.crop(flat, r).shape for r in vision.REGIONS] == [(5, 6, 3), (6, 10, 3)]


def test_partial_ratios_of_many_pairs():
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("ab#0 लख") for _ in range(rng.choice([0, 1, 5, 6, 63, 64])))
    a, b = [text() for _ in range(1500)], [text() for _ in range(1500)]
    assert fuzzy.partial_ratios(a, b).tolist() == [fuzzy.partial_ratio(x, y) for x, y in zip(a, b, strict=True)]


def test_all_constituencies_are_resolved(spark, small):
    """Each within its district, against all rows of it by brute force."""
    rows = [r.asDict() for r in queries.constituencies(spark, small).collect()]
    got = {r["req_id"]: (r["status"], r["score"], r["candidates"]) for r in queries.resolve_fuzzy_topk(spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        name = r["constituency"].replace("ust", "st")
        scores = {o["id"]: fuzzy.partial_ratio(name, o["constituency"]) for o in rows if o["district_id"] == r["district_id"]}
        best = max(scores.values())
        tied = sorted(i for i, x in scores.items() if x == best)
        status, score, candidates = got[r["id"]]
        assert score == best and status == (resolve.RESOLVED if len(tied) == 1 else resolve.AMBIGUOUS)
        assert candidates == ("" if len(tied) == 1 else ",".join(map(str, tied[:5])))
