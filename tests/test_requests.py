from pyspark.sql import functions as F

from ledgerlark.operators import requests as Q


def test_lookups(spark):
    users = spark.createDataFrame([(1, "asha1", "a@b.c"), (2, "ravi2", None)], "id int, username string, email string")
    assert Q.by_unique(users, "username", "ASHA1").first()["id"] == 1
    assert Q.by_unique(users, "email", "").count() == 0 and Q.by_key(users, "id", 3).count() == 0


def test_registration(spark):
    rows = [("Asha", "asha1", "secret", None, "superadmin", None), (" ", "abc", "123", "12", "guest", None), ("R", "ravi22", "secret", "9876543210", "booth", 0), ("R", None, None, "", "district", 4)]
    df = spark.createDataFrame([(f, u, p, m, r, None, i, None, i) for f, u, p, m, r, i in rows], "first_name string, username string, password string, mobile string, role string, mandal_id int, district_id int, constituency_id int, booth_id int")
    got = [r[0] for r in df.select(Q.registration_issues()).collect()]
    assert got[0] == [] and len(got[1]) == 5 and got[2] == ["booth_id is required"] and got[3] == ["username is required", "password is required"]


def test_uploads(spark):
    df = spark.createDataFrame([("image/png", 5), ("image/png", Q.UPLOAD_BYTES + 1), ("text/html", 5), (None, 5)], "kind string, size long")
    assert [r[0] for r in df.select(Q.upload_issue(F.col("kind"), F.col("size"))).collect()] == [None, "FILE_TOO_LARGE", "INVALID_FILE_TYPE", "INVALID_FILE_TYPE"]


def test_tags_and_replies(spark):
    df = spark.createDataFrame([("1", ("x", ""))], "code string, reply struct<voter_name:string,state:string>")
    row = df.select(Q.source_tag(F.col("code"), {"1": "2023"}, "2008").alias("t"), Q.reply_fields(F.col("reply"), {"name": "voter_name", "state": "state"}).alias("f")).first()
    assert row["t"] == "2023" and row["f"].asDict(True) == {"name": {"value": "x", "confidence": 0.99}, "state": {"value": None, "confidence": 0.0}, "district": {"value": None, "confidence": 0.0}}


def test_names_only(spark):
    res = spark.createDataFrame([(1, "resolved", 7), (2, "unresolved_not_found", None)], "req_id int, status string, match_id int")
    c = spark.createDataFrame([(7, "English", "", 3)], "id int, constituency string, constituency_hindi string, district_id int")
    d = spark.createDataFrame([(3, "ज़िला")], "district_id int, district_name_hi string")
    assert sorted(map(tuple, Q.names_only(res, c, d).collect())) == [(1, "English", "ज़िला"), (2, None, None)]
