"""Digests across runs: two runs equal one, and the stored side is read where it lies."""

import random

from pyspark.sql import functions as F

from heddle.operators import chunks
from heddle.sources.seen import SeenTable


def test_runs_equal_one(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, None if rng.random() < 0.02 else "hot" if rng.random() < 0.4 else f"t{rng.randrange(300)}") for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, text string")
    table = SeenTable(spark, "seen_test", 8, str(tmp_path / "seen"))
    found = []
    for k in range(3):
        part = df.where((F.col("id") >= 400 * k) & (F.col("id") < 400 * (k + 1)))
        fresh = table.fresh(part, F.md5("text"), "id")
        if k:
            plan = fresh._jdf.queryExecution().executedPlan().toString()
            stored_side = plan[plan.rindex("Bucketed: true") - 400 :]
            assert "SortMergeJoin" in plan and "Exchange" not in stored_side.split("Scan parquet")[0].split("SortMergeJoin")[-1].split("\n")[-1]
            # One exchange for the batch's aggregate, one to the table's buckets; none above the table.
            assert plan.count("Exchange hashpartitioning") <= 2 and "rangepartitioning" not in plan
        new = fresh.collect()
        found += [(r["digest"], r["id"]) for r in new]
        table.remember(spark.createDataFrame(new, "digest string, id long"))
        table.remember(spark.createDataFrame(new[:3], "digest string, id long"))
        assert table.fresh(part, F.md5("text"), "id").count() == 0
    whole = df.where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("id").alias("id"))
    assert sorted(found) == sorted((r["digest"], r["id"]) for r in whole.collect())
    spark.sql("DROP TABLE seen_test")  # its files stay, as after the end of a session
    later = SeenTable(spark, "seen_later", 8, str(tmp_path / "seen"))
    assert later.fresh(df, F.md5("text"), "id").count() == 0
    assert later.fresh(spark.createDataFrame([(1, "unseen")], "id long, text string"), F.md5("text"), "id").count() == 1
    spark.sql("DROP TABLE seen_later")


def test_keep_first_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), i % 7, rng.choice(["hot", "hot", *"abcdefg"])) for i in range(500)] + [(1, 1, None)]
    df = spark.createDataFrame(rows, "a int, b int, t string").withColumn("extra", F.monotonically_increasing_id())
    got = {(r["t"], r["a"], r["b"]) for r in chunks.keep_first(df, F.col("t"), "a", "b").collect()}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = {(t, *min(((a, b) for a, b, x in rows if x == t), key=key)) for t in {r[2] for r in rows} - {None}}
    assert got == want
