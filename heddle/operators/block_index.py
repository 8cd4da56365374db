"""A stored BM25 index in blocks with score bounds, and top-k search that reads only blocks that can matter.

Chunks get places in the order of ``cluster`` columns (so that chunks alike lie together) and blocks of ``2 ** bits`` neighbouring places. A posting block holds the
places of one term in one such block, as offsets from its start, with their frequencies, and the largest score that any of them reaches without the term's
weight. Blocks of different terms cover the same chunks, so the sum of a query's weights times these bounds is a bound for every chunk of a block.

Search takes three steps, all joins. (1) Bounds of all blocks that hold a query's terms, from the bounds alone: posting lists are not read. (2) The ``first`` blocks with the highest
bounds are scored; the k-th score is a floor. (3) Of the other blocks those whose bound reaches the floor are scored. A block below it holds no chunk of the top k, so the result is that
of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import counted, stored
from .retrieval import inverse_frequency, query_terms, top_ranked

TABLES = ("blocks", "docs", "terms", "stats")


@dataclass
class BlockIndex:
    """Index tables: blocks (term, block, offsets, tfs, top), docs (block, ids, lengths), terms (term, df, idf), stats (n, avgdl, k1, b)."""

    blocks: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame


def _saturated(tf: Column, dl: Column, avgdl: Column, k1: Column, b: Column) -> Column:
    """A posting's score without its term's weight."""
    tf = tf.cast("double")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl.cast("double") / F.when(avgdl > 0, avgdl).otherwise(1.0)))


def build(chunks: DataFrame, cluster: tuple[str, ...] = (), k1: float = 1.5, b: float = 0.75, bits: int = 7, text_col: str = "text", id_col: str = "chunk_id") -> BlockIndex:
    """Index tables from one pass over the texts. Chunks without tokens count as chunks."""
    tokens = F.coalesce(text.tokens(F.col(text_col)), F.array().cast("array<string>"))
    slim = chunks.select(F.col(id_col).alias("chunk_id"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(cluster)), tokens.alias("tokens"))
    order = [f"_c{i}" for i in range(len(cluster))] + ["chunk_id"]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    block, offset = F.shiftright("place", bits), F.col("place").bitwiseAND((1 << bits) - 1).cast("short")
    rows = stored(placed.select(block.alias("block"), offset.alias("offset"), "chunk_id", F.size("tokens").alias("dl"), "tokens"), "placed")
    stats = stored(rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).select("n", (F.col("t") / F.greatest("n", F.lit(1))).alias("avgdl"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")), "stats")
    one = F.array_sort(F.collect_list(F.struct("offset", "chunk_id", "dl")))
    docs = rows.groupBy("block").agg(one.alias("x")).select("block", F.col("x.chunk_id").alias("ids"), F.col("x.dl").alias("lengths"))
    # Dealt by block once: both aggregates find their keys together, and a block's term is no hot key.
    tf = rows.select("block", "offset", "dl", "tokens").repartition("block").select("block", "offset", "dl", F.explode("tokens").alias("term")).groupBy("term", "block", "offset", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    part = _saturated(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("k1"), F.col("b"))
    lists = tf.crossJoin(F.broadcast(stats)).groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("offset", "tf"))).alias("x"), F.max(part).alias("top"))  # stats: one row
    blocks = stored(lists.select("term", "block", F.col("x.offset").alias("offsets"), F.col("x.tf").alias("tfs"), "top"), "blocks")
    terms = blocks.groupBy("term").agg(F.sum(F.size("offsets")).alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", inverse_frequency(F.col("n"), F.col("df")).alias("idf"))
    return BlockIndex(blocks, stored(docs, "docs"), stored(terms, "terms"), stats)


def write(index: BlockIndex, path: str) -> None:
    """Index tables as Parquet; posting blocks lie by term."""
    for name in TABLES:
        df = getattr(index, name)
        if name == "blocks":
            df = df.repartitionByRange("term").sortWithinPartitions("term", "block")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


#: Scores are compared as they are rounded, and bounds are sums in another order.
SLACK = 2e-6


def _weights(index: BlockIndex, queries: DataFrame) -> DataFrame:
    asked = query_terms(queries).join(index.terms, "term")
    return stored(asked.select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")).where("weight > 0"), "weights")


def _scores(index: BlockIndex, weights: DataFrame, chosen: DataFrame, digits: int) -> DataFrame:
    """``(query_id, chunk_id, score)`` of all chunks in ``chosen`` (query_id, block): only their posting blocks go through the joins."""
    asked = counted(stored(weights.select("term").distinct(), "asked-terms"))
    # All sides are dealt by block: posting lists move once, and what is made of them for each query is summed where it is made.
    lists = index.blocks.join(asked, "term", "left_semi").select("term", "block", F.arrays_zip("offsets", "tfs").alias("x")).repartition("block")
    wanted = chosen.groupBy("block").agg(F.collect_set("query_id").alias("queries"))
    lists = lists.join(wanted, "block").join(index.docs, "block").crossJoin(F.broadcast(index.stats))  # stats: one row
    hits = lists.select("block", "term", "x", "ids", "lengths", "avgdl", "k1", "b", F.explode("queries").alias("query_id")).join(counted(weights), ["query_id", "term"])
    hits = hits.select("query_id", "block", "weight", "ids", "lengths", "avgdl", "k1", "b", F.explode("x").alias("p"))
    at = F.col("p.offsets").cast("int")
    part = F.col("weight") * _saturated(F.col("p.tfs"), F.get("lengths", at), F.col("avgdl"), F.col("k1"), F.col("b"))
    sums = hits.select("query_id", "block", F.get("ids", at).alias("chunk_id"), part.alias("part")).groupBy("block", "query_id", "chunk_id").agg(F.round(F.sum("part"), digits).alias("score"))
    return sums.select("query_id", "chunk_id", "score").where("score > 0")


def search(index: BlockIndex, queries: DataFrame, k: int = 20, first: int = 8, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """The ranked list ``(query_id, rank, chunk_id, score)``, and ``(query_id, blocks, scored)``: how many blocks hold a query's terms and how many were scored."""
    weights = _weights(index, queries)
    bounds = index.blocks.select("term", "block", "top").join(counted(weights), "term").groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    bounds = stored(bounds, "bounds")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    ahead = stored(bounds.withColumn("_n", place).where(F.col("_n") <= first).select("query_id", "block"), "first-blocks")
    found = stored(_scores(index, weights, ahead, digits), "first-scores")
    floor = top_ranked(found, k).where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("floor"))
    rest = bounds.join(ahead, ["query_id", "block"], "left_anti").join(floor, "query_id", "left").where(F.col("bound") + SLACK >= F.coalesce("floor", F.lit(0.0)))
    rest = stored(rest.select("query_id", "block"), "other-blocks")
    ranked = top_ranked(found.unionByName(_scores(index, weights, rest, digits)), k)
    scored = ahead.unionByName(rest).groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
    return ranked, bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(scored, "query_id", "left").fillna(0, ["scored"])
