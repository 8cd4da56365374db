"""Usage reports from mergeable sketches, one row a day and call type: what a day adds is read once, any range of days is a merge of small rows.

Latencies go into KLL quantile sketches, sessions into HyperLogLog sketches, matched guardrail patterns into frequent-item sketches; counts and sums are exact. The exact reports are in
``usage``. Errors: a quantile's rank is off by about 2.3 / ``k`` (0.3 % at 800) of the values, a distinct count by about 1.04 / sqrt(2 ** ``lg_k``) (1.6 % at 12); patterns are exact
while a range has fewer than ``tracked`` different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKED = "event_type = 'guardrail' and guardrail_allowed = 0 and guardrail_matched is not null"


def daily(events: DataFrame, k: int = 800, lg_k: int = 12, tracked: int = 1000) -> DataFrame:
    """``(day, call_type, events, latency, sessions, patterns)``: one aggregate, with partial sketches on the map side."""
    return events.groupBy(F.to_date("timestamp").alias("day"), "call_type").agg(
        F.count(F.lit(1)).alias("events"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("latency"), F.hll_sketch_agg("session_id", lg_k).alias("sessions"),
        F.expr(f"approx_top_k_accumulate(guardrail_matched, {tracked}) FILTER (WHERE {BLOCKED})").alias("patterns"),
    )


def store(sketches: DataFrame, path: str) -> None:
    """Writes days; a day that is written again replaces itself."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged(sketches: DataFrame, since: Column | None = None, until: Column | None = None, tracked: int = 1000) -> DataFrame:
    """The sketches of a range of days by call type; the range prunes stored days."""
    if since is not None:
        sketches = sketches.where(F.col("day") >= since)
    if until is not None:
        sketches = sketches.where(F.col("day") <= until)
    return sketches.groupBy("call_type").agg(F.sum("events").alias("events"), F.kll_merge_agg_double("latency").alias("latency"), F.hll_union_agg("sessions").alias("sessions"), F.expr(f"approx_top_k_combine(patterns, {tracked})").alias("patterns"))


def report(sketches: DataFrame, top: int = 10, share: float = 0.95) -> DataFrame:
    """``(call_type, events, samples, p95, sessions, patterns array<struct<pattern, n>>)`` of merged sketches; p95 is null without samples."""
    n = F.kll_sketch_get_n_double("latency")
    found = F.expr("approx_top_k_estimate(patterns, 1000)")
    ordered = F.array_sort(F.transform(found, lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("pattern"))))
    pairs = F.transform(F.slice(ordered, 1, top), lambda x: F.struct(x["pattern"].alias("pattern"), (-x["less"]).alias("n")))
    return sketches.select("call_type", "events", n.alias("samples"), F.when(n > 0, F.kll_sketch_get_quantile_double("latency", F.lit(share))).alias("p95"), F.hll_sketch_estimate("sessions").alias("sessions"), pairs.alias("patterns"))
