"""Scratch tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Rows of narrow tables that are broadcast at most.
BROADCAST_ROWS = 200_000


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without it, as in tests, gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="heddle-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast when it was counted to be small."""
    return F.broadcast(table) if table.count() <= most else table
