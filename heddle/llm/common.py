"""Helpers that the training-data operators share: shared scratch tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder

WHITE = "\t\n\x0b\x0c\r "


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("")))


BROADCAST_IDS = 1_000_000


def drop_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``: a broadcast up to ``BROADCAST_IDS`` ids, a shuffle beyond.

    Rows with a null id stay.
    """
    ids = materialize(ids.toDF("__hd_gone").where("__hd_gone is not null").distinct(), "ids")
    gone = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(gone, docs[id_col] == gone["__hd_gone"], "left_anti")


def small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast when it was counted to be small; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: rows ``(node, component)`` for every node that has an edge.

    ``component`` is the smallest node id of the component. Randomised contraction: in each round a
    node moves to the neighbour (or itself) with the lowest hashed priority, edges are renamed, loops and
    repeats go. A constant share of the nodes goes in each expected round, so the number of rounds is
    logarithmic, also for long paths and stars. Only counts come to the driver; the renaming table is broadcast while it is
    counted to be small and shuffled beyond. Null ends and self-loops are dropped.
    """
    live = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    live = live.where("a is not null and b is not null and a <> b")
    live = materialize(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    where: DataFrame | None = None
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def prio(c: str, salt: int = turn):
            return F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("p"), F.col(c).alias("v"))

        up = both.groupBy("a").agg(F.min(prio("b")).alias("best"))
        up = materialize(up.select(F.col("a").alias("u"), F.least(F.col("best"), prio("a"))["v"].alias("parent")), "cc-up")
        names = small(up)
        live = live.join(names.withColumnsRenamed({"u": "a", "parent": "pa"}), "a").join(names.withColumnsRenamed({"u": "b", "parent": "pb"}), "b")
        live = live.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        live = materialize(live, "cc-edges")
        if where is None:
            where = up.select(F.col("u").alias("node"), F.col("parent").alias("at"))
        else:
            where = where.join(names.withColumnsRenamed({"u": "at", "parent": "next"}), "at", "left").select("node", F.coalesce("next", "at").alias("at"))
            where = materialize(where, "cc-nodes")
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    if where is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = materialize(where.groupBy("at").agg(F.min("node").alias("component")), "cc-least")
    return materialize(where.join(small(least), "at").select("node", "component"), "components")
