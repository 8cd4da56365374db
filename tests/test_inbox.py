"""The request source: ranges, pushed days, broken lines, and a stream that goes on where it was."""

import json
import os

import pytest
from pyspark.sql import functions as F

from heddle.sources import inbox


def post(root, day, name, *lines, end="\n"):
    os.makedirs(f"{root}/{day}", exist_ok=True)
    with open(f"{root}/{day}/{name}.jsonl", "ab") as f:
        for line in lines:
            f.write((line if isinstance(line, bytes) else json.dumps(line, ensure_ascii=False).encode()) + end.encode())


def message(i, **more):
    return {"id": i, "From": f"+91{i}", "To": "+1", "Body": f"नमस्ते {i}", "at": "2024-01-02T03:04:05"} | more


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(inbox.InboxSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield str(tmp_path / "in")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("size", [1, 37, 10**6])
def test_batch(spark, source, size):
    for d in range(1, 4):
        post(source, f"2024-01-0{d}", "a", *(message(10 * d + i) for i in range(5)), b"", b"\xff{", b'{"Body": 5}', b"[1]")
        post(source, f"2024-01-0{d}", "b", message(100 + d, at="never"), message(200 + d, Body="x\r"))
    post(source, "notes", "a", message(1))
    df = spark.read.format("inbox").option("path", source).option("piece_bytes", size).load()
    got = df.collect()
    good = [r for r in got if r["error"] is None]
    assert len(got) == 3 * 10 and len(good) == 3 * 6
    assert {r["body"] for r in good if r["file"] == "a.jsonl"} == {f"नमस्ते {10 * d + i}" for d in range(1, 4) for i in range(5)}
    assert all(r["received_at"] is not None and r["sender"].startswith("+91") for r in good)
    assert {r["body"] for r in got if r["error"] and r["file"] == "a.jsonl"} == {"�{", '{"Body": 5}', "[1]"}
    assert df.where("day = date'2024-01-02'").count() == 10 and df.where("day >= date'2024-01-02' and request_id = '20'").count() == 1 and df.where("day in (date'2024-01-01', date'2024-01-03')").count() == 20


def test_days_are_not_listed_in_vain(spark, source):
    for d in range(1, 4):
        post(source, f"2024-01-0{d}", "a", message(d))
    reader = inbox.InboxReader(source, 10**6)
    import datetime as dt

    list(reader.pushFilters([inbox.GreaterThan(("day",), dt.date(2024, 1, 1)), inbox.LessThanOrEqual(("day",), dt.date(2024, 1, 2)), inbox.EqualTo(("sender",), "x")]))
    assert [p.day for p in reader.partitions()] == ["2024-01-02"]


def run(spark, source, tmp_path):
    stream = spark.readStream.format("inbox").option("path", source).option("piece_bytes", 200).load()
    q = stream.select("day", "file", "at", "request_id", "error").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    q.awaitTermination()
    return sorted(str(r["request_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_stream_goes_on_at_its_offset(spark, source, tmp_path):
    post(source, "2024-01-01", "a", *(message(i) for i in range(6)))
    post(source, "2024-01-02", "a", message(10), b"broken")
    half = json.dumps(message(11)).encode()
    post(source, "2024-01-02", "a", half[:20], end="")  # a line that is still being written
    want = [*map(str, range(6)), "10", "None"]
    assert run(spark, source, tmp_path) == sorted(want)
    post(source, "2024-01-02", "a", half[20:])
    post(source, "2024-01-02", "b", message(12))
    post(source, "2024-01-03", "a", message(13))
    want += ["11", "12", "13"]
    assert run(spark, source, tmp_path) == sorted(want)
    for d in range(4, 8):
        post(source, f"2024-01-0{d}", "a", message(20 + d))
        want.append(str(20 + d))
    assert run(spark, source, tmp_path) == sorted(want) == run(spark, source, tmp_path)
    keys = inbox.InboxStream(source, 100, 2).latestOffset()["files"]
    assert sorted(keys) == ["2024-01-06/a.jsonl", "2024-01-07/a.jsonl"]


def test_no_folder(spark, source):
    assert spark.read.format("inbox").option("path", source + "/none").load().select(F.col("body")).count() == 0
