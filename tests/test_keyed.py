"""Keyed tables: replays change nothing, untouched buckets keep their files, cut-off batches are made whole."""

import datetime as dt
import os
import random
import shutil

from pyspark.sql import functions as F

from heddle.sources import keyed
from heddle.sources.schemas import CACHE

ROW = "k string, v long"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_epochs(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = spark.createDataFrame([], ROW).schema
    table = keyed.KeyedTable(spark, path, "k", schema, 8)
    assert rows(table) == []
    put = keyed.put_latest("k", F.desc("v"))
    batch = lambda pairs: spark.createDataFrame(pairs, ROW)
    table.change(1, batch([(f"k{i}", i) for i in range(40)] + [(None, 5), ("k3", 1)]), put)
    first = rows(table)
    assert first == sorted((f"k{i}", i) for i in range(40))
    before = files(path)
    table.change(2, batch([("k3", 99), ("new", 1)]), put)
    second = rows(table)
    assert second == sorted([*(p for p in first if p[0] != "k3"), ("k3", 99), ("new", 1)])
    after = files(path)
    assert all(after[f] == t for f, t in before.items()) and 1 <= len({f.split("_bucket=")[1].split("/")[0] for f in set(after) - set(before)}) <= 2
    table.change(2, batch([("k3", 99), ("new", 1)]), put)
    assert rows(table) == second
    # Cut off halfway: one of the batch's buckets lacks its version; the replay writes it again.
    lost = next(os.path.dirname(f) for f in files(path) if "_epoch=2" in f)
    shutil.rmtree(lost)
    assert rows(table) != second
    table.change(2, batch([("k3", 99), ("new", 1)]), put)
    assert rows(table) == second
    assert sorted(map(tuple, table.read(before=2).collect())) == first
    table.change(3, batch([(f"k{i}", 0) for i in range(40)]), keyed.drop_keys("k"))
    assert rows(table) == [("new", 1)]
    assert table.vacuum() > 0 and rows(table) == [("new", 1)] and table.vacuum() == 0
    table.change(4, batch([]), put)
    assert rows(table) == [("new", 1)]


def test_cache_hits_count_once(spark, tmp_path):
    """A stream of hits and stores, restarted, replayed: counts are those of the log."""
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "cache_key", CACHE, 4)
    now = F.lit(dt.datetime(2024, 1, 1))
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", " ")], "cache_key string, response string").withColumns({"call_type": F.lit("general_answer"), "lang": F.lit("en")})
    table.change(1, new, keyed.put_responses(now))
    hits = spark.createDataFrame([("a",), ("a",), ("b",), ("nobody",)], "cache_key string")
    for _ in range(3):
        table.change(2, hits, keyed.add_hits)
    assert {r["cache_key"]: (r["response"], r["hit_count"]) for r in table.read().collect()} == {"a": ("x", 2), "b": ("y", 1)}
    table.change(3, new.where("cache_key = 'a'").withColumn("response", F.lit("z")), keyed.put_responses(now))
    assert {r["cache_key"]: (r["response"], r["hit_count"]) for r in table.read().collect()} == {"a": ("z", 2), "b": ("y", 1)}


def test_stream_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    log = [(f"k{rng.randrange(30)}", i) for i in range(300)]
    schema = spark.createDataFrame([], ROW).schema
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", schema, 8)
    for i in range(3):
        spark.createDataFrame(log[i * 100 : (i + 1) * 100], ROW).repartition(3).write.parquet(str(tmp_path / "in" / f"p={i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        table.follow(stream, keyed.put_latest("k", F.desc("v")), str(tmp_path / "cp")).awaitTermination()
    got = dict(map(tuple, table.read().collect()))
    assert set(got) == {k for k, _ in log}
    # Within a file order is by value, so each key ends with a value of its last batch.
    assert all(v >= 200 or not any(k == x and i >= 200 for x, i in log) for k, v in got.items())
