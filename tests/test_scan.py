"""Segmented folds against folds over whole keys: hot keys, folds that never forget, restarts at every cut."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators import scan, state


@pytest.fixture
def parts(spark):
    """Sets the number of partitions for a test."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def requests(seed, n=4000):
    """A third of all rows on one key, in one long run of overlapping windows and gaps."""
    rng = random.Random(seed)
    keys = ["hot"] * 3 + [f"k{i}" for i in range(6)] + [None]
    return [(rng.choice(keys), rng.randrange(n * 2), i, rng.choice([5, 50, 2000])) for i in range(n)]


def plain_ttl(rows):
    until, out = {}, []
    for k, at, i, ttl in sorted(rows, key=lambda r: (r[1], r[2])):
        hit = k in until and at <= until[k]
        if not hit:
            until[k] = at + ttl
        out.append((k, i, int(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 7, 60])
def test_ttl_of_a_hot_key(spark, parts, n):
    parts(n)
    rows = requests(n)
    df = spark.createDataFrame(rows, "k string, at long, i long, ttl long").select("*", F.lit(1).alias("_lead"))
    got = state.replay_ttl(df, "k", "at", F.col("ttl"), "i")
    assert got.columns == ["k", "at", "i", "hit"]
    assert sorted(((r["k"], r["i"], r["hit"]) for r in got.collect()), key=repr) == plain_ttl(rows)


def test_hot_key_is_spread(spark, parts):
    parts(24)
    df = spark.createDataFrame(requests(3, 6000), "k string, at long, i long, ttl long")
    out = scan.segmented_fold(df, "k", ["at", "i"], ["at"], lambda s, r: (r[0], 0), None, T.IntegerType())
    sizes = {r["_part"]: r["count"] for r in out.groupBy("_part").count().collect()}
    hot = out.where("k = 'hot'").select("_part").distinct().count()
    assert max(sizes.values()) <= 3 * 6000 / 24 and hot >= 5


def plain_recent(rows, keep=5):
    recent = {}
    for k, _, e in sorted(rows, key=lambda r: r[1]):
        if e is not None:
            have = recent.setdefault(k, [])
            recent[k] = have if e in have else [e, *have][:keep]
    return recent


@pytest.mark.parametrize("n, kinds", [(1, 4), (9, 6), (40, 12)])
def test_recent_entities_of_a_hot_key(spark, parts, n, kinds):
    parts(n)
    rng = random.Random(n)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([None, *"abcdefghijkl"[:kinds]])) for i in range(2500)]
    df = spark.createDataFrame(rows, "key long, o long, recent string")
    got = {r["key"]: r["recent"] for r in state.recent_entities(df, "key", "recent", "o").collect()}
    assert got == plain_recent(rows)


def test_a_fold_that_never_forgets(spark, parts):
    """A running sum depends on every row before: the rounds go on to the end of the line."""
    parts(8)
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.randrange(9)) for i in range(600)]
    out = scan.segmented_fold(spark.createDataFrame(rows, "k string, o long, v long"), "k", ["o"], ["v"], lambda s, r: (s + r[0], s + r[0]), 0, T.LongType())
    w = Window.partitionBy("k").orderBy("o")
    bad = out.withColumn("want", F.sum("v").over(w)).where("want <> _out or _out is null").count()
    assert bad == 0 and out.count() == 600


@pytest.mark.parametrize("n", [1, 16])
def test_last_known_of_a_hot_key(spark, parts, n):
    parts(n)
    rng = random.Random(n)
    rows = [(rng.choice([7, 7, 7, 8, None]), i, rng.choice([None] * 30 + [1.5, 2.5]), rng.choice([None] * 200 + ["x", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, a double, b string")
    got = state.carried_forward(df, "k", "o", "a", "b")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(w) for c in "ab"})
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, at long, i long, ttl long")
    assert state.replay_ttl(empty, "k", "at", F.col("ttl"), "i").count() == 0
    assert state.recent_entities(empty, "k", "ttl", "at").count() == 0
    assert state.carried_forward(empty, "k", "at", "ttl").count() == 0
