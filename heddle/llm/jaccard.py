"""Exact n-gram Jaccard join in the Jaccard metric space, and near-duplicate classes from it.

Documents become sets of 64-bit shingle keys; equal sets are one point. The join then works in rounds of pivots:

1. Element pivots. The singletons {s} are the pivots of the first level. Under a total order of all shingles a set lies in the
   Voronoi cell of its first element, and by the triangle inequality a set within distance 1 - t of it can only lie in
   the cells of its first n - ceil(t n) + 1 elements: that window replicates the set into the cells it may have to
   meet. Cells with one member go. Shingles that many documents share come last in the order, so cells of common passages
   hold only documents that are made of common passages.
2. Document pivots. Each cell elects a few pivot documents; members are measured against pivots exactly. Those within the
   radius join the pivot's class at once: inside the ball no pair is ever formed.
3. What is left are pairs of different classes in one cell. They must pass the length window, the overlap that
   their ordered windows still allow, and the triangle inequality to a common pivot; the rest is measured exactly.

Each measure is an exact set intersection, and each discarded pair is provably too far apart, so the classes are exact. Links inside a
class are spanning ones. The order of the shingles comes from their counts over all documents, so cells do not grow with the corpus: a key held
by fewer than ``LEAST`` documents makes a cell no larger than that. The counted keys are broadcast up to ``order_most`` of them; beyond, each
text gets those of its own shingles by a join.

Defined cases. Null, empty or blank text: empty set, no links. Fewer than ``k`` words: the whole sequence is the one shingle. Null
doc_id: no part in the join, null component. Rows that repeat a doc_id are one document; it links where one of its texts does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, connected_components, drop_ids, materialize, small
from .words import Words, chunks, mix, windows

#: Bits of a key below its frequency class.
BITS = 58
#: Shingles counted at least this often come later in the order, by the logarithm of their count.
LEAST = 8
PIVOTS = 8
#: Cells with more members than this are cut into blocks of about BLOCK.
LARGE_CELL = 32
BLOCK = 1024
SLAB = 2048
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 18


def _sets(batch: pa.RecordBatch, col: int, k: int) -> list[np.ndarray]:
    """The distinct shingle keys (58 bits) of each row. Words are hashed in smaller pieces than callers cut, as that takes many arrays of their number."""
    out = []
    for piece in chunks(batch, col, PIECE):
        w = Words(piece.column(col))
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            h = w.h[a:b]
            out.append(np.unique(windows(h, min(k, len(h)) or 1) >> np.uint64(64 - BITS)))
    return out


def _ordered(keys: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Keys in the join's order: by frequency class, which takes the high bits, then by hash."""
    if len(common) and len(keys):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        keys = np.sort(np.where(common[at] == keys, keys | (level[at] << np.uint64(BITS)), keys))
    return keys.astype(np.int64)


def common_shingles(docs: DataFrame, k: int) -> DataFrame:
    """``(key, level)`` of the shingles that count ``LEAST`` or more over all documents; the level is the logarithm of the count.

    Keys are counted within a task's chunk first, up to 63, which shares a word with the key; so a common shingle leaves each chunk as one row.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 0):
                sets = _sets(part, 0, k)
                keys, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((keys << np.uint64(6) | np.minimum(n, 63).astype(np.uint64)).view(np.int64))], ["x"])

    key = F.shiftrightunsigned("x", 6)
    rows = docs.where("text is not null").select("text").mapInArrow(run, "x long").repartition(key)
    counts = rows.groupBy(key.alias("key")).agg(F.sum(F.col("x").bitwiseAND(63)).alias("n")).where(F.col("n") >= LEAST)
    return counts.select("key", F.least(F.floor(F.log2("n")), F.lit(31)).alias("level"))


def with_common(docs: DataFrame, common: DataFrame, k: int) -> DataFrame:
    """``docs`` with ``common``: the counted shingles of the row's text as ``(key, level)``, by joins on key and text hash."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2):
                sets = _sets(part, 2, k)
                row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                keys = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(keys)], ["h1", "h2", "key"])

    hashed = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    held = hashed.where("text is not null").select("h1", "h2", "text").mapInArrow(run, "h1 long, h2 long, key long").join(common, "key")
    own = held.groupBy("h1", "h2").agg(F.collect_set(F.struct("key", "level")).alias("common"))
    return hashed.join(own, ["h1", "h2"], "left").select("doc_id", "text", "common")


def points(docs: DataFrame, shared, k: int, num: int, den: int) -> DataFrame:
    """``(doc_id, n, f1, f2, p, edge, plain, head)``: set size, fingerprint, window length, its last key, how many of its keys are rare, the window.

    Counted shingles come from the broadcast ``shared`` (sorted keys, levels), or from the column ``common`` where that is None.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                n, f1, f2, p, edge, plain, heads = [], [], [], [], [], [], []
                own = part.column(2).to_pylist() if shared is None else None
                for i, keys in enumerate(_sets(part, 1, k)):
                    size = len(keys)
                    m = mix(keys)
                    n.append(size)
                    f1.append(int(m.sum().astype(np.int64)) if size else 0)
                    f2.append(int(mix(m ^ np.uint64(0x5DEECE66D)).sum().astype(np.int64)) if size else 0)
                    if own is None:
                        known = shared.value
                    else:
                        pairs = sorted((x["key"], x["level"]) for x in own[i] or [])
                        known = np.array([x for x, _ in pairs], np.uint64), np.array([x for _, x in pairs], np.uint64)
                    ordered = _ordered(keys, *known)
                    plain.append(int(np.searchsorted(ordered, 1 << BITS)))
                    head = ordered[: size - (num * size + den - 1) // den + 1] if size else ordered
                    p.append(len(head))
                    edge.append(int(head[-1]) if size else None)
                    heads.append(head)
                arrays = [part.column(0), *(pa.array(x, pa.int64()) for x in (n, f1, f2, p, edge, plain)), pa.array(heads, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "f1", "f2", "p", "edge", "plain", "head"])

    cols = ["doc_id", "text"] + (["common"] if shared is None else [])
    return docs.select(*cols).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, p long, edge long, plain long, head array<long>")


def _only(df: DataFrame, col: str, ids: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose ``col`` is among ``ids`` (column ``id``, n rows): broadcast while small, shuffled beyond."""
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return df.join(ids, df[col] == ids["id"], "left_semi") if n > BROADCAST_IDS else df.join(ids.withColumnRenamed("id", col), col, "left_semi")


def overlaps(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``pairs`` (x, y) with exact set sizes ``nx``, ``ny`` and intersection size ``o``."""
    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), "pair-ids")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(np.int64) for x in _sets(part, 1, k)], pa.list_(pa.int64()))], ["id", "s"])

    needed = _only(docs.select("doc_id", "text"), "doc_id", ids, ids.count()).mapInArrow(run, "id long, s array<long>")
    sets = materialize(needed, "sets")
    x = sets.select(F.col("id").alias("x"), F.col("s").alias("sx"))
    y = sets.select(F.col("id").alias("y"), F.col("s").alias("sy"))
    return pairs.join(x, "x").join(y, "y").select("x", "y", F.size("sx").alias("nx"), F.size("sy").alias("ny"), F.size(F.array_intersect("sx", "sy")).cast("long").alias("o"))


def block_pairs(large: DataFrame, heads: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """``(x, y)``: pairs of different classes in large cells that their windows allow to be linked.

    A cell of m members becomes blocks of about ``block`` by hash; every pair of blocks is one task group, whatever m is. A pair counts in the cell
    of its first common key only.
    """
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(2), "rep"), blocks).cast("int")
    rows = large.withColumn("nb", blocks).withColumn("own", own).join(heads, "rep")
    meet = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    rows = rows.withColumn("ij", F.explode(meet)).select("key", "ij.i", "ij.j", "own", "rep", "component", "n", "p", "edge", "head")

    def run(group, table):
        key, i, j = (g.as_py() for g in group)
        own, rep, comp, n, p, edge = (table.column(c).to_numpy() for c in ("own", "rep", "component", "n", "p", "edge"))
        lists = table.column("head").combine_chunks()
        flat, sizes = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
        keys, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        some = times[inverse] > 1
        member, column = np.repeat(np.arange(len(rep)), sizes)[some], number[inverse[some]]
        before = int((keys[times > 1] < key).sum())
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        c, earlier = np.zeros((len(a), len(b)), np.float32), np.zeros((len(a), len(b)), bool)
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        for lo in range(0, int((times > 1).sum()), SLAB):  # shared keys, some columns at a time
            x, y = np.searchsorted(column, [lo, lo + SLAB])
            grid = np.zeros((len(rep), SLAB), np.float32)
            grid[member[x:y], column[x:y] - lo] = 1
            c += grid[a] @ grid[b].T
            if lo < before:
                earlier |= grid[a, : before - lo] @ grid[b, : before - lo].T > 0.5
        c = np.rint(c).astype(np.int64)
        nu, nb_ = n[a][:, None], n[b][None, :]
        reach = np.where(edge[a][:, None] <= edge[b][None, :], (n - p)[a][:, None], (n - p)[b][None, :])
        ok = ~earlier & (comp[a][:, None] != comp[b][None, :]) & (nu * den >= nb_ * num) & (nb_ * den >= nu * num) & ((num + den) * (c + reach) >= num * (nu + nb_))
        if i == j:
            ok &= rep[a][:, None] < rep[b][None, :]
        q, r = np.nonzero(ok)
        xs, ys = [np.minimum(rep[a[q]], rep[b[r]])], [np.maximum(rep[a[q]], rep[b[r]])]
        return pa.Table.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in (xs, ys)], ["x", "y"])

    return rows.groupBy("key", "i", "j").applyInArrow(run, "x long, y long").where("x <> y")


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", order_most: int = 4_000_000, large_cell: int = LARGE_CELL, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)`` for every row: ``class_id`` is the smallest doc_id with an equal set,
    ``component_id`` the smallest reachable by links of similarity num / den or more."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = materialize(common_shingles(docs, k), "common-shingles")
    if common.count() <= order_most:
        found = common.toArrow()
        keys, level = (found.column(c).to_numpy().astype(np.uint64) for c in ("key", "level"))
        order = np.argsort(keys)
        pts = points(docs, docs.sparkSession.sparkContext.broadcast((keys[order], level[order])), k, num, den)
    else:
        pts = points(with_common(docs, common, k), None, k, num, den)
    pts = materialize(pts, "points")
    slim = pts.select("doc_id", "n", "f1", "f2")
    some = slim.where("doc_id is not null and n > 0")
    reps = materialize(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "reps")
    members = materialize(some.join(reps, ["f1", "f2", "n"]).select("doc_id", "rep", "f1", "f2").distinct(), "members")

    # Level 1: windows of element pivots, cells with company.
    ids = reps.select(F.col("rep").alias("id")).distinct()
    heads = _only(pts.where("n > 0"), "doc_id", ids, reps.count())
    cells = heads.select(F.col("doc_id").alias("rep"), F.explode("head").alias("key"))
    cells = cells.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("m > 1")
    cells = materialize(cells.select("key", "rep").distinct(), "cells")
    info = materialize(_only(pts.where("n > 0").select("doc_id", "n", "p", "edge", "plain"), "doc_id", ids, reps.count()).groupBy(F.col("doc_id").alias("rep")).agg(F.min("n").alias("n_min"), F.max("n").alias("n"), F.max(F.col("n") - F.col("p")).alias("rest"), F.min("p").alias("p"), F.min("edge").alias("edge"), F.max("edge").alias("edge_max"), F.min("plain").alias("plain")), "info")

    def sides(pairs: DataFrame) -> DataFrame:
        a = info.select(*(F.col(c).alias(f"{c}_x" if c != "rep" else "x") for c in info.columns))
        b = info.select(*(F.col(c).alias(f"{c}_y" if c != "rep" else "y") for c in info.columns))
        near = (F.col("n_x") * den >= F.col("n_min_y") * num) & (F.col("n_y") * den >= F.col("n_min_x") * num)
        return pairs.join(a, "x").join(b, "y").where(near)

    linked = (F.col("nx") + F.col("ny") - F.col("o")) * num <= F.col("o") * den

    # Level 2: a few pivot documents a cell, each the first of its members under one of several global priorities, so that the cells of
    # a family agree on them. A pivot's ball becomes part of one class without forming pairs.
    w = Window.partitionBy("key")
    pivots = F.array_distinct(F.array(*(F.min(F.struct((F.col("plain") if j % 2 else F.lit(0)).alias("c"), F.xxhash64(F.lit(j), "rep").alias("p"), "rep")).over(w)["rep"] for j in range(PIVOTS))))
    stars = cells.join(info.select("rep", "plain"), "rep").select("rep", pivots.alias("x")).select("rep", F.explode("x").alias("pivot")).where("rep <> pivot")
    stars = stars.groupBy(F.least("rep", "pivot").alias("x"), F.greatest("rep", "pivot").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    stars = sides(stars).where(F.col("c") * 10 >= F.least("p_x", "p_y")).select("x", "y")
    stars = materialize(overlaps(docs, stars, k).withColumn("d", 1 - F.col("o") / (F.col("nx") + F.col("ny") - F.col("o"))), "stars")
    balls = stars.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = connected_components(balls)
    both = stars.select(F.col("y").alias("rep"), F.col("x").alias("pivot"), "d").union(stars.select("x", "y", "d")).union(stars.select("x", F.col("x").alias("y"), F.lit(0.0))).union(stars.select("y", F.col("y").alias("x"), F.lit(0.0)))
    near = both.groupBy("rep").agg(F.min(F.struct(F.xxhash64(F.lit(0), "pivot").alias("p"), "pivot", "d")).alias("v")).select("rep", F.col("v.d").alias("d"), F.col("v.pivot").alias("pivot"))

    # Level 3: pairs of different classes in a cell. Cells with few members pair in a join; large ones are cut into blocks, which
    # find by matrix products which pairs the windows still allow, so that pairs are not made one by one.
    tagged = cells.join(small(first.withColumnRenamed("node", "rep")), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    tagged = tagged.withColumns({"lo": F.min("component").over(w), "hi": F.max("component").over(w), "m": F.count(F.lit(1)).over(w)}).where("lo <> hi").select("key", "rep", "component", "m")
    tagged = materialize(tagged, "tagged")
    large = tagged.where(F.col("m") > large_cell)
    lists = large.groupBy("rep").agg(F.collect_list("key").alias("big"))
    sized = tagged.where(F.col("m") <= large_cell).join(info.select("rep", "n", "n_min"), "rep").join(near, "rep", "left")
    sized = materialize(sized, "small-cells")
    left = sized.select("key", *(F.col(c).alias(f"{c}_l") for c in ("rep", "component", "n", "n_min", "d", "pivot")))
    right = sized.select("key", *(F.col(c).alias(f"{c}_r") for c in ("rep", "component", "n", "n_min", "d", "pivot")))
    radius = 1 - num / den + 1e-9
    apart = F.coalesce((F.col("pivot_l") == F.col("pivot_r")) & (F.abs(F.col("d_l") - F.col("d_r")) > radius), F.lit(False))
    meet = (left["key"] == right["key"]) & (F.col("rep_l") < F.col("rep_r")) & (F.col("component_l") != F.col("component_r")) & (F.col("n_l") * den >= F.col("n_min_r") * num) & (F.col("n_r") * den >= F.col("n_min_l") * num) & ~apart
    pairs = left.join(right, meet).groupBy(F.col("rep_l").alias("x"), F.col("rep_r").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    # What two windows share: the keys met here and those of large cells that both hold. The set whose window ends first can share beyond
    # them only what lies after its window.
    sided = sides(pairs).join(lists.withColumnsRenamed({"rep": "x", "big": "big_x"}), "x", "left").join(lists.withColumnsRenamed({"rep": "y", "big": "big_y"}), "y", "left")
    shared = F.col("c") + F.coalesce(F.size(F.array_intersect("big_x", "big_y")), F.lit(0))
    reach = F.when(F.col("edge_max_x") <= F.col("edge_y"), F.col("rest_x")).when(F.col("edge_max_y") <= F.col("edge_x"), F.col("rest_y")).otherwise(F.greatest("rest_x", "rest_y"))
    possible = (num + den) * (shared + reach) >= num * (F.col("n_min_x") + F.col("n_min_y"))
    in_blocks = block_pairs(large, heads.select(F.col("doc_id").alias("rep"), "n", "p", "edge", "head"), num, den, block)
    candidates = sided.where(possible).select("x", "y").union(in_blocks).distinct()
    rest = overlaps(docs, candidates, k).where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))

    # Classes of classes: only links between different ones are left to follow.
    again = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    links = rest.union(again).join(small(first.select(F.col("node").alias("a"), F.col("component").alias("ca"))), "a", "left").join(small(first.select(F.col("node").alias("b"), F.col("component").alias("cb"))), "b", "left")
    links = links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    last = connected_components(links)
    home = members.join(small(first.withColumnRenamed("node", "rep")), "rep", "left").select("doc_id", "f1", "f2", "rep", F.coalesce("component", "rep").alias("mid"))
    home = home.join(small(last.withColumnsRenamed({"node": "mid", "component": "top"})), "mid", "left").select("doc_id", "f1", "f2", "rep", F.coalesce("top", "mid").alias("component_id"))
    home = home.select(*(F.col(c).alias(f"_{c}" if c != "component_id" else c) for c in home.columns))
    out = slim.join(home, (slim["doc_id"] == home["_doc_id"]) & (slim["f1"] == home["_f1"]) & (slim["f2"] == home["_f2"]), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_rep", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **join) -> DataFrame:
    """``docs`` with one document of each class: the one whose id is the class's component id; rows without an id or without words stay."""
    found = jaccard_classes(docs, id_col=id_col, text_col=text_col, **join)
    return drop_ids(docs, id_col, found.where("doc_id <> component_id").select("doc_id"))
