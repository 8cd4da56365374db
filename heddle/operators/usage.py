"""Reports on the usage event log: each is one pass of conditional or grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def of_session(events: DataFrame, session_id: str | None) -> DataFrame:
    """One session's events, or all of them for an empty id; the filter reaches the scan."""
    return events.where(F.col("session_id") == session_id) if session_id else events


def nearest_rank_p95(values: DataFrame, by: list[str], value: str, least: int = 20) -> DataFrame:
    """``(by..., p95)``: the value at 0-based place min(floor(0.95 n), n - 1) of the sorted non-null values; no row under ``least`` values.

    Equal values are counted first, on the map side. Their counts are range-partitioned by group and value, so a group of any size
    spreads over partitions; the sizes of its parts tell which part holds the place, and only that one is ranked. Places are in integers.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = stored(counts.repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id()), "p95-counts")
    same = Window.partitionBy(*by)
    sizes = parts.groupBy(*by, "_p").agg(F.sum("_c").alias("_s")).withColumn("_n", F.sum("_s").over(same))
    sizes = sizes.withColumn("_upto", F.sum("_s").over(same.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    place = F.least(F.expr("(_n * 95) div 100"), F.col("_n") - 1) + 1
    sizes = sizes.withColumn("_place", place - F.col("_upto") + F.col("_s")).where((F.col("_n") >= least) & F.col("_place").between(1, F.col("_s")))
    chosen = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, "_p")), "_place")
    near = parts.join(chosen, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_p")])
    upto = F.sum("_c").over(same.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("_u", upto).where(F.col("_place").between(F.col("_u") - F.col("_c") + 1, F.col("_u")))
    return found.select(*by, F.col("_v").alias("p95"))


def token_summary(events: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Calls, hits, tokens and latency by call type (and session): one aggregate, and p95 for groups of any size joined to it."""
    by = by or ["session_id", "call_type"]
    sums = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("cache_hit"), F.lit(0)).alias("cache_hits"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.round(F.avg("latency_ms"), digits).alias("avg_latency_ms"),
    )
    top = nearest_rank_p95(events, by, "latency_ms").select(*(F.col(c).alias(f"_{c}") for c in by), F.round("p95", digits).alias("p95_latency_ms"))
    held = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return sums.join(top, held, "left").drop(*(f"_{c}" for c in by))


def grand_total(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.sum(F.coalesce("total_tokens", F.lit(0))), F.lit(0)).alias("grand_total_tokens"))


def percent(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def guardrail_totals(events: DataFrame, session_id: str | None = None) -> DataFrame:
    g = of_session(events, session_id).where("event_type = 'guardrail'")
    blocked = F.count_if(F.col("guardrail_allowed") == 0)
    total = F.count(F.lit(1))
    lat = F.col("latency_ms")
    return g.agg(
        total.alias("total"), blocked.alias("blocked"), (total - blocked).alias("allowed"), percent(blocked, total).alias("block_rate_pct"),
        F.round(F.avg(lat), 6).alias("avg_latency_ms"), F.round(F.avg(F.when(F.col("guardrail_stage") == 1, lat)), 6).alias("avg_latency_stage1"), F.round(F.avg(F.when(F.col("guardrail_stage") == 2, lat)), 6).alias("avg_latency_stage2"),
    )


def guardrail_breakdown(events: DataFrame, session_id: str | None = None) -> DataFrame:
    """``(section, item, n)`` of blocked messages by reason and by stage: one scan with grouping sets; null is an item."""
    g = of_session(events, session_id).where("event_type = 'guardrail' and guardrail_allowed = 0")
    sets = g.groupingSets([[F.col("guardrail_reason")], [F.col("guardrail_stage")]], F.col("guardrail_reason"), F.col("guardrail_stage")).agg(F.count(F.lit(1)).alias("n"), F.grouping("guardrail_reason").alias("_r"))
    return sets.select(F.when(F.col("_r") == 0, "reason").otherwise("stage").alias("section"), F.when(F.col("_r") == 0, F.col("guardrail_reason")).otherwise(F.col("guardrail_stage").cast("string")).alias("item"), "n")


def top_patterns(events: DataFrame, session_id: str | None = None, top: int = 10) -> DataFrame:
    g = of_session(events, session_id).where("event_type = 'guardrail' and guardrail_allowed = 0 and guardrail_matched is not null")
    return g.groupBy(F.col("guardrail_matched").alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(top)


def cache_by_call_type(events: DataFrame, session_id: str | None = None) -> DataFrame:
    e = of_session(events, session_id)
    hit = F.col("cache_hit") == 1
    miss = F.col("cache_hit").isNull() | (F.col("cache_hit") == 0)
    out = e.groupBy("call_type").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("hits"),
        F.avg(F.when(hit, F.col("latency_ms"))).alias("_hot"), F.avg(F.when(miss, F.col("latency_ms"))).alias("_cold"), F.avg(F.when(miss, F.col("total_tokens"))).alias("_tokens"),
    )
    saved = F.bround(F.coalesce("_tokens", F.lit(0.0)) * F.col("hits"), 0).cast("long")
    return out.select("call_type", "calls", "hits", percent(F.col("hits"), F.col("calls")).alias("hit_rate_pct"), F.round("_hot", 6).alias("avg_latency_cached"), F.round("_cold", 6).alias("avg_latency_uncached"), saved.alias("tokens_saved"))


def cache_totals(events: DataFrame, session_id: str | None = None) -> DataFrame:
    by = cache_by_call_type(events, session_id)
    return by.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("total_calls"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"), percent(F.sum("hits"), F.sum("calls")).alias("hit_rate_pct"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"))


def recent_sessions(events: DataFrame, top: int = 50) -> DataFrame:
    return events.groupBy("session_id").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("events")).orderBy(F.desc("last_seen"), "session_id").limit(top)


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries and hits by call type, and the total where ``call_type`` is null and ``is_total`` 1."""
    return cache.rollup("call_type").agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"), F.grouping("call_type").cast("int").alias("is_total"))


def live_searches(events: DataFrame, session_id: str | None = None) -> DataFrame:
    return of_session(events, session_id).where("event_type = 'tavily'").select("id", "timestamp", "query_text", "confidence", "tavily_fired", "tavily_error", "latency_ms").orderBy("id")


def presented(df: DataFrame, digits: int = 2) -> DataFrame:
    """Averages rounded for display, on their exact binary value (2.675 is below its tie and gives 2.67); nulls stay."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c)).try_cast("double")) for c in doubles})


def run_outcomes(runs: DataFrame) -> DataFrame:
    """``(status, n, key)``: a row for each run with its outcome and how many share it; nothing is gathered in one row."""
    n = runs.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("status", "_status")
    return runs.join(n, F.col("status").eqNullSafe(F.col("_status"))).select("status", "n", "key")
