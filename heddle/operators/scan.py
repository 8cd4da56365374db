"""Folds over the ordered rows of each key, cut into segments, so that a key with any share of all rows spreads over all tasks.

Rows are range-partitioned by key and order, which cuts long keys wherever a partition ends. Every partition folds its rows at once; its first key starts from the empty
state, as a guess. Each partition tells its first and last key and the state it ends with: a few values a partition, put in line on the driver. A partition whose first key began
earlier and whose guess was wrong is folded again, its first key only, from the state that the partition before it ended with; that may change the state it
ends with in turn, so rounds go on until every start is right. A fold that forgets (an entry that expires, a list that is pushed out) needs one round,
whatever the number of partitions; a round settles one more partition of a key at least, so the result is exact for any fold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import counted, stored

#: ``(state, values of a row) -> (state, output)``; states survive a trip through JSON.
Fold = Callable[[object, tuple], tuple[object, object]]


def _folded(batches: Iterator[pa.RecordBatch], key: int, inputs: list[int], width: int, fold: Fold, start, entries: dict | None, kind: pa.DataType, last_only: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with the output, the partition, whether a row is of its first key, and what the ends tell; ``entries`` are given for a second pass."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    state, at, first_key, begun = start, None, None, False
    put_off = None  # an output that shows once its row turns out to be the last of its key

    def mark(row: int, into: tuple, **what) -> None:
        into[4][row] = json.dumps((json.loads(into[4][row]) if into[4][row] else {}) | what)

    def close(row: int, into: tuple) -> None:
        if last_only:
            into[1][row] = put_off
        mark(row, into, state=state, whole=at == first_key)

    def arrow(h: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*h[0].columns[:width], pa.array(h[1], kind), pa.array(h[2], pa.int32()), pa.array(h[3], pa.bool_()), pa.array(h[4], pa.string())], names=names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, values = batch.column(key).to_pylist(), list(zip(*(batch.column(i).to_pylist() for i in inputs)))
        parts = [part] * n if entries is None else batch.column(width).to_pylist()
        mine = (batch, [None] * n, parts, [True] * n, [None] * n)
        for i in range(n):
            fresh = not begun or (entries is not None and parts[i] != part)
            if fresh:
                if begun:
                    close(i - 1, mine if i else held)  # -1 is the last row of the batch before
                begun, part, first_key = True, parts[i], keys[i]
                state = start if entries is None else entries[part]
                mark(i, mine, first=True)
            elif keys[i] != at:
                if last_only:
                    (mine if i else held)[1][i - 1] = put_off
                state = start
            at = keys[i]
            state, put_off = fold(state, values[i])
            if not last_only:
                mine[1][i] = put_off
            mine[3][i] = at == first_key
        if held:
            yield arrow(held)
        held = mine
    if held:
        close(-1, held)
        yield arrow(held)


def segmented_fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], fold: Fold, start, output: T.DataType, last_only: bool = False) -> DataFrame:
    """``rows`` with ``_out``, what the fold gave for each row (or, with ``last_only``, for the last row of each key in a partition, null elsewhere), and ``_part``."""
    names = rows.columns
    shape = T.StructType([*rows.schema.fields, T.StructField("_out", output), T.StructField("_part", T.IntegerType()), T.StructField("_lead", T.BooleanType()), T.StructField("_told", T.StringType())])
    kind = _arrow(output)
    at, width = names.index(key), len(names)
    args = (at, [names.index(c) for c in inputs], width, fold, start)

    def first(batches):
        return _folded(batches, *args, None, kind, last_only, shape.names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = stored(rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).mapInArrow(first, shape), "segments")
    ends: dict[int, dict] = {}
    for r in done.where("_told is not null").select("_part", F.col(key).alias("k"), "_told").collect():
        told = json.loads(r["_told"])
        end = ends.setdefault(r["_part"], {})
        if "first" in told:
            end["first"] = r["k"]
        if "state" in told:
            end |= {"last": r["k"], "state": told["state"], "whole": told["whole"]}
    line = sorted(ends)
    assumed = {p: start for p in line}
    again: dict[int, int] = {}
    redone: list[DataFrame] = []
    while True:
        entries = {p: ends[q]["state"] for q, p in zip(line, line[1:]) if ends[q]["last"] == ends[p]["first"] and ends[q]["state"] != assumed[p]}
        if not entries:
            break

        def second(batches, entries=entries):
            return _folded(batches, *args, entries, kind, last_only, shape.names)

        lead = done.where(F.col("_lead") & F.col("_part").isin(list(entries))).select(*names, "_part")
        fixed = stored(lead.repartition(n, "_part").sortWithinPartitions("_part", *order).mapInArrow(second, shape), "segments-again")
        for r in fixed.where("_told like '%state%'").select("_part", "_told").collect():
            if ends[r["_part"]]["whole"]:
                ends[r["_part"]]["state"] = json.loads(r["_told"])["state"]
        assumed |= entries
        redone.append(fixed)
        again |= {p: len(redone) for p in entries}
    if not again:
        return done.drop("_lead", "_told")
    out = done.where(~(F.col("_lead") & F.col("_part").isin(list(again))))
    for turn, fixed in enumerate(redone, 1):
        out = out.unionByName(fixed.where(F.col("_part").isin([p for p, t in again.items() if t == turn])))
    return out.drop("_lead", "_told")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def last_known(rows: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """Each row with the last known value of ``cols`` up to it, as ``last_<col>``: a window within each range partition, and what the partitions before it of the same key knew.

    Built-in functions only. A key's partitions number as many as there are tasks at most, so the second window is short.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.repartitionByRange(n, key, order).withColumn("_part", F.spark_partition_id()), "segments")
    inside = Window.partitionBy("_part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(inside) for c in cols})
    # Of each partition and key: its last known values.
    known = cut.groupBy(F.col(key).alias("_key"), "_part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumns({f"_from_{c}": F.last(c, ignorenulls=True).over(before) for c in cols})
    some = F.lit(False)
    for c in cols:
        some = some | F.col(f"_from_{c}").isNotNull()
    carried = counted(stored(known.where(some).select("_key", F.col("_part").alias("_at"), *(f"_from_{c}" for c in cols)), "carried"))
    out = out.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    return out.withColumns({f"last_{c}": F.coalesce(f"last_{c}", f"_from_{c}") for c in cols}).drop("_part", "_key", "_at", *(f"_from_{c}" for c in cols))
