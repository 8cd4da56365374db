"""Daily sketches against the exact reports: bounds, merges of days, days written again."""

import datetime as dt
import random

from pyspark.sql import functions as F

from heddle.operators import sketches, usage

EVENTS = "session_id string, timestamp timestamp, event_type string, call_type string, latency_ms double, guardrail_allowed int, guardrail_matched string"


def events(spark, n=20_000):
    rng = random.Random(4)
    rows = []
    for _ in range(n):
        blocked = rng.random() < 0.3
        rows.append((f"s{int(rng.expovariate(1 / 900))}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(9 * 1440)), "guardrail" if blocked else "llm_call", rng.choice(["a", "a", "a", "b"]), rng.choice([None, rng.lognormvariate(3, 1)]), int(not blocked), f"p{int(rng.expovariate(0.4))}" if blocked else None))
    rows.append(("s1", dt.datetime(2024, 1, 3), "llm_call", "none", None, 1, None))
    return spark.createDataFrame(rows, EVENTS)


def test_sketches_are_near_the_exact_reports(spark, tmp_path):
    e = events(spark).cache()
    path = str(tmp_path / "daily")
    sketches.store(sketches.daily(e.where("timestamp < '2024-01-05'")), path)
    sketches.store(sketches.daily(e.where("timestamp >= '2024-01-05'")), path)
    sketches.store(sketches.daily(e.where("to_date(timestamp) = '2024-01-07'")), path)  # written again
    stored = spark.read.parquet(path)
    for since, until in ((None, None), ("2024-01-03", "2024-01-06")):
        own = e if since is None else e.where(f"to_date(timestamp) between '{since}' and '{until}'")
        lits = [None if d is None else F.lit(d).cast("date") for d in (since, until)]
        got = {r["call_type"]: r for r in sketches.report(sketches.merged(stored, *lits)).collect()}
        exact = {r["call_type"]: r for r in own.groupBy("call_type").agg(F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("m"), F.count_distinct("session_id").alias("s"), F.sort_array(F.collect_list("latency_ms")).alias("v")).collect()}
        assert set(got) == set(exact) == {"a", "b", "none"}
        for c, r in got.items():
            x = exact[c]
            assert (r["events"], r["samples"]) == (x["n"], x["m"]) and abs(r["sessions"] - x["s"]) <= max(1, 0.06 * x["s"])
            if x["m"]:
                assert abs(sum(v <= r["p95"] for v in x["v"]) / x["m"] - 0.95) <= 0.01
            else:
                assert r["p95"] is None
            want = own.where((F.col("call_type") == c) & F.expr(sketches.BLOCKED))
            assert [(p["pattern"], p["n"]) for p in r["patterns"]] == [(p["pattern"], p["n"]) for p in usage.top_patterns(want).collect()]


def test_empty(spark):
    assert sketches.report(sketches.merged(sketches.daily(events(spark, 1).where("false")))).count() == 0
