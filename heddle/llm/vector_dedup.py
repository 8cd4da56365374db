"""Near-duplicate vectors by collision-counting projections.

Equal vectors of a label are one class, weighted by its members. Every class is projected on seeded random unit directions. Two unit vectors with a cosine of at
least ``cosine`` are at most ``r = sqrt(2 - 2 cosine)`` apart, so on one direction they differ by at most r, and by at most the window w with a
probability that follows from the dimension alone (the coordinate of a random unit vector). A pair collides on a direction when it lies in each other's window; its
collisions over all directions are counted, and the calibrated count is the largest that a pair at the threshold reaches with the wanted ``recall``.
Pairs that reach it are verified by their cosine in double precision, so nothing below the threshold is linked.

How Spark cuts the work. A label's classes are dealt into cells: tables of k projections each, a cell being one combination of the k half-lines. k and the number of
tables come from the number of classes by one cost rule: more bits mean smaller cells, but more tables to keep the recall. A few thousand classes give k = 0, one table
with one cell, where the recall is that of the count alone. Cells with more than ``block`` classes (a family of near copies may hold a third of all rows) are cut into blocks by
hash, and pairs of blocks are compared, so a task holds two blocks at most. Inside, both blocks are sorted by their first projection and each run of rows meets the slice within r
of it; then the windows of the other projections are counted. A pair that meets in several tables counts in the first only, which both rows' cell codes tell.
A task returns a count a class and the edges of a spanning forest of what it linked, never pairs: rows out are bounded by rows in.

``n_links`` of a family whose members all differ is exact, and so takes one comparison a pair, in blocks.

Defined cases. Vectors that are null, empty, zero, or hold null or non-finite entries, and rows with a null label or id, link with nothing. Vectors of different lengths never
link. Rows that repeat id, label and vector count once; an id with several vectors has a row for each. Every vector gets a row, linked or not. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, small

SEED = 20_240_229
MOST_BITS = 30


@lru_cache(maxsize=64)
def directions(d: int, count: int, salt: int) -> np.ndarray:
    """``d x count`` unit directions, the same in every task."""
    a = np.random.default_rng([SEED, d, salt]).normal(size=(count, d))
    return (a / np.linalg.norm(a, axis=1, keepdims=True)).T


def window(d: int, reach: float, chance: float) -> float:
    """The w with which two points ``reach`` apart differ by at most w on a random direction, with probability ``chance``."""
    if d == 1:
        return reach
    angle = np.linspace(0, math.pi / 2, 20_001)
    mass = np.cos(angle) ** (d - 2)
    share = np.concatenate([[0], np.cumsum((mass[1:] + mass[:-1]) / 2)])
    return reach * math.sin(float(np.interp(chance, share / share[-1], angle)))


def least_count(m: int, chance: float, loss: float) -> int:
    """The largest count that ``m`` trials reach but for a probability of ``loss``."""
    tail, missed = 0.0, m + 1
    while missed and tail <= loss:
        missed -= 1
        tail += math.comb(m, missed) * (1 - chance) ** missed * chance ** (m - missed)
    return m - missed


def tables(k: int, cosine: float, loss: float) -> int:
    """Tables of ``k`` half-lines that a pair at the threshold needs to meet in one, but for a probability of ``loss``."""
    meet = (1 - math.acos(cosine) / math.pi) ** k
    return 1 if meet >= 1 else max(1, math.ceil(math.log(loss) / math.log1p(-meet)))


def bits(n: int, cosine: float, loss: float, copy_cost: float) -> int:
    """The cheapest k for ``n`` classes: comparisons a class, plus what a copy of it costs, over all tables."""
    return min(range(MOST_BITS + 1), key=lambda k: tables(k, cosine, loss) * (n / 2**k + copy_cost))


def _unit(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = np.asarray(arr.flatten()).astype(np.float64).reshape(len(arr), d)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of large or tiny entries stay in range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, d, h1, h2, v)``; d is null for what links with nothing."""
    v, one = F.col(vector_col), vectors.schema[vector_col].dataType.elementType
    v = v if isinstance(one, (T.FloatType, T.DoubleType)) else v.cast("array<double>")
    fine = v.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    return out.select("vec_id", "label", F.when(F.col("fine"), F.size("v")).alias("d"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")


def linked(left: pa.Table, right: pa.Table | None, d: int, table: int, m: int, reach: float, width: float, need: int, cosine: float):
    """``(rows, counts, roots)`` of two blocks (or of one with itself): weighted links of each row and its place's root in a spanning forest."""
    both = left if right is None else pa.concat_tables([left, right])
    n, cut = both.num_rows, left.num_rows
    u = _unit(both.column("v"), d)
    p = (u @ directions(d, m, 0)).astype(np.float32)
    weight = both.column("copies").to_numpy()
    codes = np.stack(both.column("codes").to_numpy()) if table else None
    a = np.arange(cut)[np.argsort(p[:cut, 0], kind="stable")]
    b = a if right is None else np.arange(cut, n)[np.argsort(p[cut:, 0], kind="stable")]
    first = p[b, 0]
    counts, root = np.zeros(n, np.int64), np.arange(n)
    slack = np.float32(1e-5)
    for k in range(0, len(a), 256):
        rows = a[k : k + 256]
        cols = b[np.searchsorted(first, p[rows[0], 0] - reach - slack) : np.searchsorted(first, p[rows[-1], 0] + reach + slack, side="right")]
        if not len(cols):
            continue
        hits = np.zeros((len(rows), len(cols)), np.int8)
        for j in range(m):
            hits += np.abs(p[rows, j][:, None] - p[cols, j][None, :]) <= np.float32(width) + slack
        found = hits >= need
        if right is None:
            found &= rows[:, None] != cols[None, :]
        some, ends = found.any(axis=1), found.any(axis=0)
        if not some.any():
            continue
        rows, cols = rows[some], cols[ends]
        good = found[np.ix_(some, ends)] & (u[rows] @ u[cols].T >= cosine)
        for s in range(table):
            good &= codes[rows, s][:, None] != codes[cols, s][None, :]
        counts[rows] += good @ weight[cols]
        if right is not None:
            counts[cols] += weight[rows] @ good
        for i, row in enumerate(rows):
            met = np.unique(root[np.append(cols[good[i]], row)])
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    return both, counts, root


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, recall: float = 1 - 1e-6, projections: int = 16, chance: float = 0.99, block: int = 2048, copy_cost: float = 4096.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector; see the module.

    ``recall`` is that of a pair at the threshold, nearer pairs have more; half of what it may lose goes to the count, half to the tables. ``copy_cost`` says how many comparisons a
    class's copy in one more table is worth.
    """
    loss, reach = (1 - recall) / 2, math.sqrt(2 - 2 * cosine)
    rows = rows_of(vectors, id_col, vector_col, label_col)
    key = ["label", "d", "h1", "h2"]
    classes = rows.where("d is not null").groupBy(*key).agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = materialize(classes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")), "labels")

    def coded(batches):
        """Adds the cell codes: in table t, which side of each of its projections the vector lies on."""
        for batch in batches:
            d, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("d", "n"))
            codes: list = [None] * batch.num_rows
            for dim, many in {*zip(d.tolist(), n.tolist())}:
                k = bits(many, cosine, loss, copy_cost)
                own = np.flatnonzero((d == dim) & (n == many))
                count = tables(k, cosine, loss)
                side = np.zeros((len(own), count), np.int64)
                if k:
                    at = batch.schema.get_field_index("v")
                    ahead = _unit(batch.column(at).take(pa.array(own)), dim) @ directions(dim, k * count, 1) > 0
                    side = (ahead.reshape(len(own), count, k) * (1 << np.arange(k))).sum(2)
                for i, codes_of in zip(own, side):
                    codes[i] = codes_of
            names = ("node", "label", "d", "copies", "v")
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(codes, pa.list_(pa.int64()))], [*names, "codes"])

    kinds = {f.name: f.dataType for f in classes.schema.fields}
    shape = T.StructType([*(T.StructField(c, kinds[c]) for c in ("node", "label", "d", "copies", "v")), T.StructField("codes", T.ArrayType(T.LongType()))])
    cells = materialize(classes.join(small(sizes), ["label", "d"]).select("node", "label", "d", "copies", "v", "n").mapInArrow(coded, shape), "codes")
    cell = ["label", "d", "table", "code"]
    spread = cells.select("node", "label", "d", F.posexplode("codes").alias("table", "code"))
    large = materialize(spread.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(*cell, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    dealt = cells.select("*", F.posexplode("codes").alias("table", "code")).join(small(large), cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(2), "node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "v", "codes")

    def compare(key, held):
        d, table, i, j = (k.as_py() for k in (key[1], key[2], key[4], key[5]))
        own = held.column("own").to_numpy()
        left, right = held.filter(pa.array(own == i)), None if i == j else held.filter(pa.array(own == j))
        kind, a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and (right is None or right.num_rows):
            wide = window(d, reach, chance)
            need = projections if wide >= reach else least_count(projections, chance, loss)
            both, counts, root = linked(left, right, d, table, projections, reach, wide, need, cosine)
            node = both.column("node").to_numpy()
            some, moved = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
            for k, x, y in ((0, node[some], counts[some]), (1, node[moved], node[root[moved]])):
                kind.append(np.full(len(x), k))
                a.append(x)
                b.append(y)
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in (kind, a, b)], ["kind", "a", "b"])

    found = materialize(dealt.groupBy(*cell, "i", "j").applyInArrow(compare, "kind long, a long, b long"), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("more"))
    comps = connected_components(found.where("kind = 1").select("a", "b"))
    named = classes.select(*key, "node", "least", "copies").join(links, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(heads, "component").select(*key, (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id"), "named")
    members = rows.select("vec_id", *key).distinct()
    out = members.join(named, key, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
