"""Objects and fragments as a data source, calls of a service, resampling."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import vision
from ledgerlark.sources import objects
from ledgerlark.streaming import client, jobs

PDF = b"""1 0 obj <</Type /Pages /Kids [2 0 R 4 0 R]>> endobj
2 0 obj <</Type /Page /Parent 1 0 R /Contents 3 0 R>> endobj
3 0 obj <<>> stream
BT 1 0 0 1 10 700 Tm (one) Tj 0 -12 Td (two) Tj ET
endstream endobj
4 0 obj <</Type /Page /Parent 1 0 R /Contents 5 0 R>> endobj
5 0 obj <<>> stream
BT 1 0 0 1 20 600 Tm (three) Tj ET
endstream endobj
"""


@pytest.fixture
def store(spark, tmp_path):
    objects.register(spark)
    for name, content in {"a/x.pdf": PDF, "a/y.pdf": PDF, "b/z.txt": b"text", "b/empty.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_objects(spark, store):
    found = spark.read.format("objects").load(store)
    assert sorted((r["path"], r["size"], bytes(r["content"])) for r in found.collect()) == [("a/x.pdf", len(PDF), PDF), ("a/y.pdf", len(PDF), PDF), ("b/empty.txt", 0, b""), ("b/z.txt", 4, b"text")]
    assert found.where("path = 'b/z.txt'").count() == 1 and found.where("path like 'a/%'").count() == 2 and found.where("path in ('a/x.pdf', 'no')").count() == 1
    assert spark.read.format("objects").option("glob", "*.txt").load(f"{store}/b").count() == 2
    assert [r["path"] for r in spark.read.format("objects").load(f"{store}/a/x.pdf").collect()] == ["x.pdf"]
    assert spark.read.format("objects").option("partition_bytes", 1).load(store).rdd.getNumPartitions() >= 3
    with pytest.raises(Exception, match="NO_ROOT"):
        spark.read.format("objects").load(f"{store}/none").count()


def test_names_need_no_bytes(spark, store):
    os.chmod(f"{store}/a/x.pdf", 0)
    (__import__("pathlib").Path(store) / "a/x.pdf").unlink()
    os.symlink("/proc/self/mem", f"{store}/a/x.pdf")  # can be listed, and not read
    names = spark.read.format("objects").schema("path string, size long").load(store)
    assert names.columns == ["path", "size"] and names.where("path = 'a/x.pdf'").count() == 1
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    with pytest.raises(Exception):
        spark.read.format("objects").load(store).where("path = 'a/x.pdf'").select(F.length("content")).collect()


def test_fragments(spark, store):
    found = objects.fragments(spark, store, glob="*.pdf")
    assert sorted(map(tuple, found.where("path = 'a/x.pdf'").collect())) == [("a/x.pdf", 0, 0, 10.0, 700.0, "one"), ("a/x.pdf", 0, 1, 10.0, 688.0, "two"), ("a/x.pdf", 1, 0, 20.0, 600.0, "three")]
    assert sorted(r["text"] for r in spark.read.format("fragments").schema("text string").option("glob", "x.pdf").load(store).collect()) == ["one", "three", "two"]


def test_objects_are_written(spark, store):
    rows = spark.createDataFrame([("c/1.bin", b"abc"), ("c/2.bin", b""), ("c/3.bin", None)], "path string, content binary")
    rows.write.format("objects").mode("append").save(store)
    assert sorted((r["path"], bytes(r["content"])) for r in spark.read.format("objects").load(f"{store}/c").collect()) == [("1.bin", b"abc"), ("2.bin", b""), ("3.bin", b"")]
    with pytest.raises(Exception, match="OBJECT_EXISTS"):
        spark.createDataFrame([("c/0.bin", b"new"), ("c/1.bin", b"other")], "path string, content binary").coalesce(1).write.format("objects").mode("append").save(store)
    rows.withColumn("content", F.lit(b"new")).write.format("objects").mode("overwrite").save(store)
    assert {bytes(r["content"]) for r in spark.read.format("objects").load(f"{store}/c").where("path <> '0.bin'").collect()} == {b"new"}


def test_calls(tmp_path):
    """A value that hangs is ended, one that fails twice is tried again, one that is wrong is not."""

    def work(value):
        if value == "hang":
            time.sleep(60)
        if value == "die":
            os._exit(3)
        if value.startswith("twice"):
            seen = tmp_path / value
            n = int(seen.read_text()) if seen.exists() else 0
            seen.write_text(str(n + 1))
            if n < 2:
                raise ConnectionError("no line")
        if value == "wrong":
            raise ValueError("no such image")
        return value.upper()

    began = time.monotonic()
    values = ["a", "hang", "twice1", "wrong", "die", *[f"v{i}" for i in range(20)]]
    got = client.Client(work, pool=3, seconds=1.0, attempts=3, pause=0.05).outcomes(values)
    assert got[0] == client.Outcome("A", None, 1) and got[2] == client.Outcome("TWICE1", None, 3)
    assert got[1] == client.Outcome(None, "no result within 1 seconds", 3) and got[3] == client.Outcome(None, "no such image", 1) and got[4] == client.Outcome(None, "the call's process has ended", 3)
    assert [o.result for o in got[5:]] == [v.upper() for v in values[5:]]
    assert time.monotonic() - began < 15
    assert not [p for p in __import__("multiprocessing").active_children()]
    assert client.Client(work).outcomes([]) == []


def test_pauses_grow(tmp_path):
    def work(value):
        with open(tmp_path / "at", "a") as f:
            f.write(f"{time.monotonic()}\n")
        raise TimeoutError("busy")

    got = client.Client(work, pool=1, attempts=4, pause=0.1, factor=2, longest=0.25).outcomes(["x"])
    at = [float(x) for x in (tmp_path / "at").read_text().split()]
    gaps = [b - a for a, b in zip(at[:-1], at[1:])]
    assert got == [client.Outcome(None, "busy", 4)] and gaps[0] >= 0.1 and gaps[1] >= 0.2 and 0.25 <= gaps[2] < 0.4


def test_called_rows_keep_their_order(spark):
    def work(value):
        time.sleep(0.05 if int(value) % 3 == 0 else 0)
        return f"<{value}>"

    df = spark.range(40).coalesce(2).select("id", F.when(F.col("id") != 7, F.col("id").cast("string")).alias("v"))
    got = client.called(df, "v", client.Client(work, pool=4)).collect()
    assert [tuple(r) for r in got] == [(i, None, None, None, 0) if i == 7 else (i, str(i), f"<{i}>", None, 1) for i in range(40)]


def test_jobs_that_hang_are_ended(spark):
    df = spark.createDataFrame([("1", "0", "pending", None, None), ("2", "30", "pending", None, None)], "id string, image_path string, status string, result string, error_message string")
    began = time.monotonic()
    got = {r["id"]: (r["status"], r["error_message"]) for r in jobs.process(df, lambda v: time.sleep(float(v)) or v, seconds=1).collect()}
    assert got == {"1": ("completed", None), "2": ("failed", "no result within 1 seconds")} and time.monotonic() - began < 20


def test_resample():
    row = np.array([[10, 20, 40]], np.uint8)
    assert vision.resample(row, 1, 3).tolist() == [[10, 20, 40]]
    assert vision.resample(row, 1, 6).tolist() == [[10, 13, 18, 25, 35, 40]]
    assert vision.resample(np.array([[0, 100]], np.uint8), 1, 4).tolist() == [[0, 25, 75, 100]]
    assert vision.resample(np.array([[0, 10, 20, 30]], np.uint8), 1, 2).tolist() == [[5, 25]]
    assert vision.resample(np.array([[0, 0], [200, 100]], np.uint8), 4, 2).tolist() == [[0, 0], [50, 25], [150, 75], [200, 100]]
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 5, 3), np.uint8)
    got = vision.resample(image, 7, 9)
    for x in range(9):
        c = min(max((x + 0.5) * 5 / 9 - 0.5, 0), 4)
        a = int(c)
        want = image[:, a] * (1 - (c - a)) + image[:, min(a + 1, 4)] * (c - a)
        assert np.abs(got[:, x] - want).max() <= 0.51
    assert vision.stack([image, image[:2, :3]]).shape == (9, 5, 3)


def test_resized(spark):
    image = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    df = spark.createDataFrame([("a", 2, 2, 3, image.tobytes()), ("b", 0, 0, 3, b""), ("c", 2, 2, 3, None)], "key string, height int, width int, nChannels int, data binary")
    got = {r["key"]: (r["height"], r["width"], r["data"] and bytes(r["data"])) for r in vision.resized(df, 4, 6).collect()}
    assert got == {"a": (4, 6, vision.resample(image, 4, 6).tobytes()), "b": (0, 0, b""), "c": (2, 2, None)}
