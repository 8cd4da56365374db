"""Sources: nested JSON folders, keyed lookups, event scans, index tables, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialogue import SLOTS
from .schemas import EVENT, SCHEME, SESSION

CORRUPT = "_corrupt_record"


def scan_documents(spark: SparkSession, path: str, schema: T.StructType = SCHEME) -> DataFrame:
    """One row for each JSON file, with ``file_key`` (the file's stem); unreadable files are dropped."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    df = df.withColumn("file_key", F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json$", 1))
    # The length keeps a data column in the scan: the reader refuses plans that ask for the corrupt record alone.
    first = F.coalesce(F.col(schema.fields[0].name).cast("string"), F.lit(""))
    return df.where(F.col(CORRUPT).isNull() & (F.length(first) >= 0)).drop(CORRUPT)


def scan_for_eligibility(schemes: DataFrame) -> DataFrame:
    """The few fields that matching needs; only the first five documents."""
    return schemes.select("id", "name_en", "name_hi", "benefit_en", "eligibility_rules", "exclusion_criteria", F.slice("documents_en", 1, 5).alias("documents"), F.col("application_url").alias("url"), "helpline")


def only_ids(schemes: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return schemes.join(ids, id_col, "left_semi")


def lookup(df: DataFrame, key_col: str, key) -> DataFrame:
    """Point lookup; on Parquet the filter reaches the scan."""
    return df.where(F.col(key_col) == F.lit(key))


def session_log(events: DataFrame, session_id: str) -> DataFrame:
    return events.where(F.col("session_id") == session_id).orderBy("id")


def decoded_sessions(rows: DataFrame) -> DataFrame:
    """Stored session rows with their nested columns, as the schema says; missing values become those of an empty session."""
    kinds = {f.name: f.dataType for f in SESSION.fields}
    out = rows.withColumns({c: F.from_json(c, kinds[c]) for c in ("confirmed_facts", "pending_slots", "conversation_buffer", "entity_memory")})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("eligibility_done", "in_eligibility_flow")})
    out = out.withColumn("pending_slots", F.coalesce("pending_slots", F.array(*map(F.lit, SLOTS)))).withColumn("conversation_buffer", F.coalesce("conversation_buffer", F.array().cast(kinds["conversation_buffer"])))
    return out.withColumns({"language": F.coalesce("language", F.lit("hi")), "language_source": F.coalesce("language_source", F.lit("default")), "turn": F.coalesce("turn", F.lit(0))})


def live_response(cache: DataFrame, key: str, now: Column) -> DataFrame:
    """The cached response of a key unless it has expired; a response that expires just now still counts."""
    return cache.where((F.col("cache_key") == key) & ~(F.col("expires_at") < now)).select("response", "expires_at")


def union_if_empty(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """``first``, or ``fallback`` when it has no rows, decided inside the plan."""
    some = first.limit(1).select(F.lit(1).alias("_some"))
    return first.unionByName(fallback.join(F.broadcast(some), F.lit(True), "left_anti"))


def search_snippets(hits: DataFrame, most: int = 800, top: int = 4) -> DataFrame:
    """``(query_id, text)``: the top non-blank hits of each query as ``[title] content`` lines; hits have rank, title, content."""
    lines = hits.where((F.trim("content") != "") & (F.col("rank") <= top)).withColumn("line", F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("] "), F.substring("content", 1, most)))
    rows = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n\n").alias("text"))


def search_texts(hits: DataFrame, most: int = 1200, top: int = 8) -> DataFrame:
    """``(scheme_id, text)``: what several searches found for a scheme; hits have scheme_id, query_no, query, rank (from 1), title, content.

    Each query that found something is a section, in order, with its ``top`` hits as ``[title] content`` lines.
    """
    line = F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, most))
    found = hits.where(F.col("rank") <= top).groupBy("scheme_id", "query_no", "query").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    section = F.concat(F.lit("=== Query: "), F.coalesce("query", F.lit("")), F.lit(" ===\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))
    rows = found.groupBy("scheme_id").agg(F.sort_array(F.collect_list(F.struct("query_no", section.alias("s")))).alias("x"))
    return rows.select("scheme_id", F.array_join(F.transform("x", lambda r: r["s"]), "\n\n").alias("text"))


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Event files as a stream; ``ts`` becomes a zoned timestamp, as watermarks need one."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))
