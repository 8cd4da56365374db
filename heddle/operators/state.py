"""Keyed state replayed in batch: buffers, entity memory, carry-forward, TTL cache, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan


def last_turns(turns: DataFrame, k: int = 8, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``k`` turns of each conversation."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def history_text(turns: DataFrame, k: int = 4, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(key, history)``: the last ``k`` turns as lines, in order; ``role`` and ``text`` of each."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Bot: ").otherwise("System: "), F.coalesce("text", F.lit("")))
    rows = last_turns(turns, k, key, order).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("history"))


def recent_entities(mentions: DataFrame, key: str, entity: str, order: str, keep: int = 5) -> DataFrame:
    """``(key, recent)``: newest-first list of the entities mentioned; a repeat does not move, unless it had been pushed out.

    An exact fold over each key's mentions in order, in segments, of which only the list at hand is kept; see ``scan``.
    """
    rows = mentions.where(F.col(entity).isNotNull()).select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(entity).alias("_e"))

    def fold(recent, row):
        if row[0] not in recent:
            recent = [row[0], *recent][:keep]
        return recent, recent

    out = scan.segmented_fold(rows, "_k", ["_o"], ["_e"], fold, [], T.ArrayType(mentions.schema[entity].dataType), last_only=True)
    return out.where(F.col("_out").isNotNull()).groupBy(F.col("_k").alias(key)).agg(F.max_by("_out", "_part").alias("recent"))


def carried_forward(rows: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """Each row with the last known value of the columns up to it, as ``last_<col>``; ``order`` is unique within a key."""
    return scan.last_known(rows, key, order, *cols)


def summary_due(turn: Column, every: int = 4) -> Column:
    return (turn > 0) & (turn % every == 0)


def replay_ttl(requests: DataFrame, key: str, ts: str, ttl: Column, *tie: str) -> DataFrame:
    """Each request with ``hit`` (1 when an unexpired entry answers it): a miss opens a window [t, t + ttl], hits do not extend it.

    ``ts`` and ``ttl`` are integers of one unit. A fold over each key's requests in order, in segments, that carries the expiry at hand; see ``scan``. A segment that
    starts inside a window guesses wrong at most until that window ends.
    """
    rows = requests.select(F.col(key), F.col(ts).cast("long").alias(ts), *tie, ttl.cast("long").alias("_ttl"))

    def fold(until, row):
        at, live = row
        if until is not None and at <= until:
            return until, 1
        return at + live, 0

    out = scan.segmented_fold(rows, key, [ts, *tie], [ts, "_ttl"], fold, None, T.IntegerType())
    return out.select(key, ts, *tie, F.col("_out").alias("hit"))


def overlay(base: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Field-wise merge: a value of ``newer`` wins where it is not null."""
    cols = [c for c in base.columns if c != key]
    n = newer.select(F.col(key), *(F.col(c).alias(f"_n_{c}") for c in cols if c in newer.columns))
    out = base.join(n, key, "full_outer")
    return out.select(key, *(F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in newer.columns else F.col(c) for c in cols))


def longer_wins(base: DataFrame, other: DataFrame, key: str, *lists: str) -> DataFrame:
    """List fields take the other side's value where that is longer."""
    n = other.select(key, *(F.col(c).alias(f"_n_{c}") for c in lists))
    out = base.join(n, key, "left")
    longer = {c: F.when(F.coalesce(F.size(f"_n_{c}"), F.lit(0)) > F.coalesce(F.size(c), F.lit(0)), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in lists}
    return out.withColumns(longer).drop(*(f"_n_{c}" for c in lists))


def pending(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets not yet done: reruns skip finished work."""
    return targets.join(done, key, "left_anti")
