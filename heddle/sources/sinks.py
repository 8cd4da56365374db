"""Sinks: append logs, keyed upserts and deletes on tables, audit text, index tables, schema growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import TTL_SECONDS


def as_json_files(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def audit(df: DataFrame, text_col: str) -> DataFrame:
    """Raw text as it is kept for audit: blank text is marked."""
    return df.withColumn(text_col, F.when(F.coalesce(F.trim(text_col), F.lit("")) == "", F.lit("EMPTY")).otherwise(F.col(text_col)))


def event_rows(df: DataFrame, schema: T.StructType, now: Column) -> DataFrame:
    """Rows as the event log takes them: missing columns null, query text cut to 300 characters, the time stamped."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if f.name == "query_text":
            c = F.substring(c.cast("string"), 1, 300)
        if f.name == "timestamp":
            c = F.coalesce(c, now) if f.name in have else now
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append(df: DataFrame, path: str, by: str = "timestamp") -> None:
    """Appends to a log that is partitioned by day, so that readers prune by date."""
    df.withColumn("day", F.to_date(by)).write.mode("append").partitionBy("day").parquet(path)


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the last in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; ``new`` has each key once."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cache_put(cache: DataFrame, new: DataFrame, now: Column, ttl: dict[str, int] | None = None, default_ttl: int = 3600) -> DataFrame:
    """The cache after storing ``new`` (cache_key, call_type, response, lang): blank responses are not stored, a stored
    key keeps its hit count, and entries live as long as their call type says."""
    seconds = F.create_map(*(F.lit(x) for kv in (ttl or TTL_SECONDS).items() for x in kv))
    rows = new.where(F.coalesce(F.trim("response"), F.lit("")) != "")
    hits = cache.select("cache_key", F.col("hit_count").alias("_hits"))
    rows = rows.join(hits, "cache_key", "left").select(
        "cache_key", F.lit("exact").alias("cache_type"), "call_type", "response", "lang", now.alias("created_at"),
        (now + F.make_dt_interval(secs=F.coalesce(F.element_at(seconds, F.col("call_type")), F.lit(default_ttl)))).alias("expires_at"),
        F.coalesce("_hits", F.lit(0).cast("long")).alias("hit_count"),
    )
    return upsert(cache, rows, "cache_key")


def encoded_sessions(sessions: DataFrame, keep: int = 8) -> DataFrame:
    """Session rows as they are stored: four nested columns as JSON, flags as 0 and 1, the last ``keep`` turns of the buffer."""
    turns = F.coalesce("conversation_buffer", F.array().cast(sessions.schema["conversation_buffer"].dataType))
    last = F.slice(turns, F.greatest(F.size(turns) - keep + 1, F.lit(1)), keep)
    out = sessions.withColumn("conversation_buffer", last)
    out = out.withColumns({c: F.to_json(c) for c in ("confirmed_facts", "pending_slots", "conversation_buffer", "entity_memory")})
    return out.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("eligibility_done", "in_eligibility_flow")})


def with_hits(cache: DataFrame, hit_log: DataFrame) -> DataFrame:
    """Hit counts raised by a log of hit keys, in one aggregate instead of one update a hit."""
    n = hit_log.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_n"))
    return cache.join(n, "cache_key", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys, key, "left_anti")


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(~(F.col("expires_at") < now))


def grown(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns that a newer schema adds, null; idempotent."""
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns))


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """An index as Parquet tables; postings are clustered by term, so that a term's rows lie together."""
    for name, df in tables.items():
        if name == "postings":
            df = df.repartitionByRange("term").sortWithinPartitions("term", "chunk_id")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
