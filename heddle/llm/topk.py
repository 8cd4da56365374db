"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are dealt into blocks; a task scores one (query block, candidate block) cell as matrix
products over quantised components and returns score histograms, never scores. Round 1 counts scores in coarse buckets, round 2 counts
single scores inside the bucket that holds the k-th value; a cell reports only the top of its histogram that
covers k, which is all that can matter to the global k-th value, so a query gets at most k counts from a cell. With the k-th
value t known, a last pass returns scores over t and, of those equal to t, as many as are missing, smallest
ids first.

Quantised components are floor(scale * x) with x as double; integer sums are exact in double arithmetic below 2**53, checked
for each cell, and in 64-bit integers beyond. Blocks have fixed sizes, so a cell's memory does not grow with the data; the
number of cells is the product of the block counts, as an exact answer to a share of all rows needs.

Defined cases. Vectors that are null or hold a null or non-finite component take no part. Where lengths differ, missing
components count as 0. Rows that repeat both id and vector count once; an id with several vectors is several candidates, and
as a query it is answered for the smallest of its vectors. A query never finds rows with its own id. Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v array<bigint>)`` of the rows that take part, without repeats."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).distinct()


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.diff(np.asarray(arr.offsets))
    flat = np.asarray(arr.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _width(*cols: pa.ChunkedArray) -> int:
    return max((int(np.diff(np.asarray(c.combine_chunks().offsets if isinstance(c, pa.ChunkedArray) else c.offsets)).max(initial=0)) for c in cols), default=0)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _top_counts(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest distinct values and their counts, down to the one that brings the count to k."""
    n = len(values)
    if n > 8 * k:
        least = np.partition(values, n - k)[n - k]
        values = values[values >= least]
    v, count = np.unique(values, return_counts=True)
    v, count = v[::-1], count[::-1]
    stop = int(np.searchsorted(np.cumsum(count), k)) + 1
    return v[:stop], count[:stop]


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, query_block: int = 2048, candidate_block: int = 16384, bucket_bits: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query`` is a condition on ``vec_id`` that names the query rows."""
    all_rows = materialize(quantise(vectors, id_col, vector_col, scale), "vectors")
    asked = all_rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, n_asked = all_rows.count(), all_rows.where(is_query).select("vec_id").distinct().count()
    blocks, asked_blocks = n // candidate_block + 1, n_asked // query_block + 1
    cand = all_rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("cb"), F.col("vec_id").alias("cand_id"), F.col("v").alias("cand_v"))
    cand = cand.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))))

    def dealt(queries: DataFrame) -> DataFrame:
        q = queries.withColumn("qb", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(asked_blocks)).cast("int"))
        return q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cells(queries: DataFrame, each, schema: str) -> DataFrame:
        """Runs ``each(query row, state, scores, ids)`` for the queries of every cell."""

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            names = [f.split()[0] for f in schema.split(", ")]
            out: list[list[np.ndarray]] = [[] for _ in names]
            if left.num_rows and right.num_rows:
                width = _width(left.column("v"), right.column("cand_v"))
                q, c = _matrix(left.column("v"), width), _matrix(right.column("cand_v"), width)
                q_ids, ids = left.column("vec_id").to_numpy(), right.column("cand_id").to_numpy()
                state = {s: left.column(s).to_numpy() for s in left.column_names if s not in ("v", "vec_id", "qb", "cb")}
                for a in range(0, len(q), 128):
                    block = _scores(q[a : a + 128], c)
                    for i, row in enumerate(block):
                        others = ids != q_ids[a + i]
                        found = each(row[others], ids[others], {s: v[a + i] for s, v in state.items()})
                        size = len(found[0])
                        for slot, x in zip(out, [np.full(size, q_ids[a + i]), *found]):
                            slot.append(x)
            return pa.Table.from_arrays([pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names)

        return dealt(queries).groupBy("qb", "cb").cogroup(cand.groupBy("qb", "cb")).applyInArrow(run, schema)

    def kth(counts: DataFrame) -> DataFrame:
        """Of each query: the value where the count from the top reaches what is wanted (or the least one), and the count above it."""
        total = counts.groupBy("query_id", "value", "wanted").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
        run = total.withColumn("upto", F.sum("n").over(w)).withColumn("above", F.col("upto") - F.col("n"))
        return run.where(F.col("above") < F.col("wanted")).groupBy("query_id").agg(F.min("value").alias("value"), F.max("above").alias("above"))

    step = 1 << bucket_bits
    coarse = cells(asked, lambda s, ids, _: _top_counts(s // step, k), "query_id long, value long, n long").withColumn("wanted", F.lit(k).cast("long"))
    state = kth(coarse).select(F.col("query_id").alias("vec_id"), F.col("value").alias("bucket"), (F.lit(k) - F.col("above")).alias("wanted"))
    within = materialize(asked.join(state, "vec_id"), "topk-state")
    fine = cells(within, lambda s, ids, st: [*_top_counts(s[s // step == st["bucket"]], int(st["wanted"]))], "query_id long, value long, n long")
    fine = fine.join(within.select(F.col("vec_id").alias("query_id"), "wanted"), "query_id")
    limit = kth(fine).select(F.col("query_id").alias("vec_id"), F.col("value").alias("kth"), F.col("above").alias("above"))
    last = within.join(limit, "vec_id").select("vec_id", "v", "kth", (F.col("wanted") - F.col("above")).alias("ties"))

    def take(s, ids, st):
        over = s > st["kth"]
        tied = np.sort(ids[s == st["kth"]])[: int(st["ties"])]
        return np.concatenate([ids[over], tied]), np.concatenate([s[over], np.full(len(tied), st["kth"])])

    hits = cells(materialize(last, "topk-limit"), take, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
