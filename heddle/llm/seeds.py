"""Word seeds shared between documents: minimiser selection, distributed neighbour comparison, fetching of word stretches.

Used by the sparse suffix array and by collinear chaining. Exact copies of whole texts are represented by their smallest
doc_id. Of rows that repeat a doc_id with different texts, one (by text hash) takes part. Null ids and null texts take none.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder
from .common import materialize, small
from .words import Words, chunks, mix, windows

BROADCAST_ROWS = 400_000


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text)`` of one document for each text, and the other members as ``(doc_id, rep)``."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    slim = materialize(_hashed(docs).select("doc_id", "h1", "h2").distinct(), "text-hashes")
    one = slim.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("doc_id", "h.h1", "h.h2")
    classes = one.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    kept = classes.select(F.col("rep").alias("doc_id"), "h1", "h2")
    many = small(materialize(classes.where("n > 1").select("h1", "h2", "rep"), "copied"), BROADCAST_ROWS)
    copies = materialize(one.join(many, ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    out = materialize(slim.join(kept, ["doc_id", "h1", "h2"], "left_anti"), "left-out")
    n = out.count()
    out = F.broadcast(out) if n <= BROADCAST_ROWS else out
    return _hashed(docs).join(out, ["doc_id", "h1", "h2"], "left_anti").select("doc_id", "text"), copies


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """Minimum or maximum of each stretch of ``w`` values, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = op(x[: len(x) - step], x[step:])
        done += step
    return x


def minimisers(h: np.ndarray, w: int, repeats: bool = False) -> np.ndarray:
    """Positions that hold the smallest value of some window of ``w`` values; of close repeats of a value the first, unless ``repeats``."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    return _minimisers(h, min(w, n), np.zeros(n, np.int64), w, repeats)


def _minimisers(h: np.ndarray, w: int, doc: np.ndarray, near: int, repeats: bool) -> np.ndarray:
    """The same for many texts one after the other: ``doc`` rises with the text, whose values have at least ``w`` places each; -1: no value of a text."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = _slide(h, w, np.minimum)
    low[(doc[: len(low)] != doc[w - 1 :]) | (doc[: len(low)] < 0)] = 0
    pad = np.zeros(w - 1, h.dtype)
    top = _slide(np.concatenate([pad, low, pad]), w, np.maximum)
    at = np.flatnonzero((top == h) & (doc >= 0))
    if repeats:
        return at
    again = np.zeros(len(at), bool)
    for lag in range(1, min(near, len(at) - 1) + 1):
        close = at[lag:] - at[:-lag] <= near
        if not close.any():
            break
        again[lag:] |= close & (h[at[lag:]] == h[at[:-lag]]) & (doc[at[lag:]] == doc[at[:-lag]])
    return at[~again]


class Lists:
    """Word lists of a batch under the names of ``Words``: ``h`` of all words, list i has words first[i]:first[i+1]."""

    __slots__ = ("first", "h")

    def __init__(self, col: pa.Array):
        offsets = np.asarray(col.offsets).astype(np.int64)
        self.first = offsets - offsets[0]
        self.h = mix(np.asarray(col.values)[offsets[0] : offsets[-1]].view(np.uint32).astype(np.uint64))


def _list_chunks(batch: pa.RecordBatch, col: int, most: int = 1 << 19):
    """Slices of a batch whose lists have about ``most`` words at most."""
    off = np.asarray(batch.column(col).offsets)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_lists(docs: DataFrame, least: int = 0) -> DataFrame:
    """``(doc_id, words array<int>)``: 32-bit word hashes of the texts of at least ``least`` words."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                words = Words(part.column(1))
                own = (words.h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array((words.first - words.first[0]).astype(np.int32)), pa.array(own[words.first[0] : words.first[-1]]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "words"]).filter(pa.array(np.diff(words.first) >= least))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<int>")


def stored_words(docs: DataFrame, least: int) -> DataFrame:
    """``word_lists`` stored in buckets of doc_id, a bucket for each shuffle partition: requests are brought to the words, which lie still."""
    spark = docs.sparkSession
    name = f"heddle_words_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = word_lists(docs, least).repartition(parts, "doc_id")
    lists.write.option("compression", "zstd").option("path", f"{folder(spark)}/{name}").bucketBy(parts, "doc_id").sortBy("doc_id").saveAsTable(name)
    return spark.table(name)


def with_words(docs: DataFrame, rows: DataFrame, doc: str, lo, hi, name: str) -> DataFrame:
    """``rows`` with the words ``lo`` ... ``hi - 1`` of their document ``doc`` as column ``name``, clipped to the text. ``docs`` has lists of words or texts."""
    docs = docs if "words" in docs.columns else word_lists(docs)
    own = docs.select(F.col("doc_id").alias("__hd_doc"), F.col("words").alias("__hd_words"))
    lo = F.greatest(lo, F.lit(0))
    return rows.join(own, rows[doc] == F.col("__hd_doc")).select(*rows.columns, F.slice("__hd_words", lo + 1, F.greatest(hi - lo, F.lit(0))).alias(name))


def window_texts(words: Words, k: int, least_words: int) -> np.ndarray:
    """For each place of ``windows(words.h, k)`` the row of the text that holds the whole window; -1 where none does or the text has fewer than ``least_words`` words."""
    n = max(len(words.h) - k + 1, 0)
    size = np.diff(words.first)
    row = np.repeat(np.arange(len(size)), size)
    inside = (row[:n] == row[k - 1 :]) & (size[row[:n]] >= least_words) if n else np.zeros(0, bool)
    return np.where(inside, row[:n], -1)


def seed_rows(docs: DataFrame, k: int, w: int, least_words: int, repeats: bool = False) -> DataFrame:
    """``(h, doc, pos)``: hashes of k words at minimiser positions of documents with at least ``least_words`` words."""
    least = max(least_words, k)

    def places(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, rows of texts and positions; texts of fewer than ``w`` seeds have windows of their own size."""
        h, row = windows(words.h, k), window_texts(words, k, max(least, k + w - 1))
        at = _minimisers(h, w, row, w, repeats)
        found = [(h[at], row[at], at - words.first[row[at]])]
        size = np.diff(words.first)
        for i in np.flatnonzero((size >= least) & (size < k + w - 1)).tolist():
            own = windows(words.h[words.first[i] : words.first[i + 1]], k)
            at = minimisers(own, w, repeats)
            found.append((own[at], np.full(len(at), i), at))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                h, row, pos = places(Words(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), part.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32))], ["h", "doc", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc long, pos int")


_MATCH = "doc long, pos int, odoc long, opos int, h long, edge boolean"


def _compare(batches):
    """Neighbours in a sorted stream of ``(h, doc, pos)``; a run of equal h is held in pieces, one document group at a time."""
    kept: list[np.ndarray] = []

    def emit(h, doc, pos, last: bool, first: bool):
        """Compares rows that end at a change of (h, doc); returns matches and the rows to carry on."""
        n = len(h)
        new_run = np.ones(n, bool)
        new_run[1:] = h[1:] != h[:-1]
        new_doc = new_run.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        group = np.cumsum(new_doc) - 1
        starts = np.flatnonzero(new_doc)
        ends = np.append(starts[1:], n) - 1
        run_of = np.cumsum(new_run)[starts]
        g = np.arange(len(starts))
        has_prev = np.zeros(len(g), bool)
        has_prev[1:] = run_of[1:] == run_of[:-1]
        has_next = np.zeros(len(g), bool)
        has_next[:-1] = has_prev[1:]
        other = np.where(has_prev, g - 1, np.where(has_next, g + 1, -1))
        # Repeats inside a document meet those of the other in their order, so that the steps of a periodic stretch lie on few diagonals, not on one each.
        nth = np.arange(n) - starts[group]
        to = other[group]
        partner = np.where(to >= 0, starts[to] + nth % (ends - starts + 1)[to], -1)
        rows = np.flatnonzero(partner >= 0)
        edge = np.zeros(n, bool)
        if first and len(g):
            edge |= group == 0
        if last and len(g):
            edge |= group == len(g) - 1
        return rows, partner[rows], np.flatnonzero(edge), starts

    def out(h, doc, pos, rows, partner, edges, skip):
        rows_ok = rows >= skip
        rows, partner = rows[rows_ok], partner[rows_ok]
        take = np.concatenate([rows, edges])
        match = np.concatenate([np.ones(len(rows), bool), np.zeros(len(edges), bool)])
        o = np.concatenate([partner, edges])
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[take]), pa.array(pos[take].astype(np.int32)), pa.array(np.where(match, doc[o], -1), mask=~match), pa.array(np.where(match, pos[o], -1).astype(np.int32), mask=~match), pa.array(h[take]), pa.array(~match)],
            ["doc", "pos", "odoc", "opos", "h", "edge"],
        )

    carry = None  # rows of the last two document groups; the first ``carry_done`` of them have been reported
    carry_done = 0
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        h, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if carry is not None:
            h, doc, pos = (np.concatenate([c, x]) for c, x in zip(carry, (h, doc, pos)))
        rows, partner, edges, starts = emit(h, doc, pos, False, first)
        # The last group may go on in the next batch: it is reported there, with the group before it kept for comparison.
        cut = int(starts[-1])
        ok = rows < cut
        # A first-of-run group right before the cut may still find its next group there; it has, as the cut starts a known group.
        if len(starts) > 1 or not first:
            yield out(h, doc, pos, rows[ok], partner[ok], edges[edges < cut] if first else np.zeros(0, np.int64), carry_done)
        keep = int(starts[-2]) if len(starts) > 1 else 0
        if len(starts) > 1:
            first = False
            carry_done = cut - keep
        carry = (h[keep:], doc[keep:], pos[keep:])
    if carry is not None:
        h, doc, pos = carry
        rows, partner, edges, _ = emit(h, doc, pos, True, first)
        edges = edges[edges >= carry_done] if not first else edges
        yield out(h, doc, pos, rows, partner, edges, carry_done)


def neighbours(rows: DataFrame) -> DataFrame:
    """``(h, doc, pos, odoc, opos)``: every seed that another document holds, with its neighbour in (h, doc, pos) order.

    The neighbour is in the document before it, or in the next one for the first document of a run; the nth occurrence in a document meets the nth of
    the other, counted round. The order is a range partitioning on
    all three columns, so a seed of a third of all documents spreads over many tasks; rows at the partition ends are compared once more.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("h", "doc", "pos")
    found = rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_compare, _MATCH)
    found = materialize(found, "neighbours")
    ends = found.where("edge").select(*order).repartition(1).sortWithinPartitions(*order).mapInArrow(_compare, _MATCH)
    both = found.where("not edge").unionByName(ends.where("not edge"))
    return both.select("h", "doc", "pos", "odoc", "opos")


#: Rows of a sorted stream that are looked at together.
_STREAM = 1 << 17
LINK, HOT, EDGE = 0, 1, 2


def _runs(few: int, hot: bool):
    """A stream of ``(h, doc, pos, at)`` sorted by h as rows ``(h, doc, pos, at, odoc, opos, oat, kind)``.

    Runs of at most ``few`` rows give their pairs in two documents (``LINK``, doc > odoc), longer ones in two documents their rows (``HOT``). The first and the last run may go on in other
    partitions: their rows are ``EDGE`` unless they are known to be hot; without ``hot`` the first ``few`` + 1, which say enough.
    """

    def work(cols: list[np.ndarray], first: bool, last: bool) -> pa.RecordBatch:
        h, doc = cols[:2]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        edge = np.zeros(len(start), bool)
        edge[0], edge[-1] = first, edge[-1] | last | (first and len(start) == 1)
        two = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        run = np.repeat(np.arange(len(start)), size)
        linked = ((size <= few) & (size > 1) & two & ~edge)[run]
        ups, downs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, few):
            i = np.flatnonzero(linked[lag:] & (run[lag:] == run[:-lag]) & (doc[lag:] != doc[:-lag]))
            ahead = doc[i + lag] > doc[i]
            ups.append(np.where(ahead, i + lag, i))
            downs.append(np.where(ahead, i, i + lag))
        known = (size > few) & two & hot
        hots = np.flatnonzero(known[run])
        edges = (edge & ~known)[run]
        if not hot:
            edges &= np.arange(len(h)) - start[run] <= few
        edges = np.flatnonzero(edges)
        up = np.concatenate([*ups, hots, edges])
        down = np.concatenate([*downs, hots, edges])
        n = len(up) - len(hots) - len(edges)
        kind = np.repeat(np.array([LINK, HOT, EDGE], np.int32), [n, len(hots), len(edges)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*(c[up] for c in cols), *(c[down] for c in cols[1:]), kind)], ["h", "doc", "pos", "at", "odoc", "opos", "oat", "kind"])

    def run(batches):
        kept, held, first = [], 0, True

        def joined():
            return [np.concatenate(x) for x in zip(*kept)]

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append([batch.column(i).to_numpy() for i in range(4)])
            held += batch.num_rows
            if held < _STREAM:
                continue
            cols = joined()
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield work([c[:cut] for c in cols], first, False)
                first, cols = False, [c[cut:] for c in cols]
            kept, held = [cols], 0
        if kept:
            yield work(joined(), first, True)

    return run


def linked_runs(rows: DataFrame, few: int, hot: bool) -> tuple[DataFrame, DataFrame]:
    """``(links, hot)`` of stored rows ``(h, doc, pos, at)``: all pairs in two documents of keys of at most ``few`` rows, ``(doc, pos, at, odoc, opos, oat)`` with doc > odoc,
    and the rows ``(h, doc, pos)`` of the other keys that two documents hold (none without ``hot``).

    One shuffle: ranges of (h, doc, pos), so a key of any size spreads over many tasks, in which only h is sorted. What lies at the ends of ranges is looked at once more.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("h", "doc", "pos", "at").repartitionByRange(parts, "h", "doc", "pos").sortWithinPartitions("h")
    found = materialize(found.mapInArrow(_runs(few, hot), "h long, doc long, pos int, at int, odoc long, opos int, oat int, kind int"), "runs")
    sure = found.where(F.col("kind") == HOT).select("h", "doc", "pos")
    edges = materialize(found.where(F.col("kind") == EDGE).select("h", "doc", "pos", "at"), "run-ends")
    keys = small(materialize(edges.select("h").distinct(), "end-keys"), BROADCAST_ROWS)
    both = edges.select("h", "doc", "pos").union(sure.join(keys, "h", "left_semi"))
    totals = both.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("doc") < F.max("doc")).alias("two"))
    totals = small(materialize(totals.where("two"), "end-totals"), BROADCAST_ROWS)
    known = edges.join(totals, "h")
    late = close_links(known.where(F.col("n") <= few), "at")
    cols = ("doc", "pos", "at", "odoc", "opos", "oat")
    links = found.where(F.col("kind") == LINK).select(*cols).union(late.select(*cols))
    return links, sure.union(known.where(F.col("n") > few).select("h", "doc", "pos")) if hot else sure


def hot_seeds(shared: DataFrame, few: int, pivots: int) -> DataFrame:
    """``(h, pivots)`` of the seeds with more than ``few`` occurrences: the first occurrences under several global priorities of documents.

    Documents of one family so share their pivots over all their seeds. Only minima and counts are gathered.
    """
    first = F.array(*(F.min(F.struct(F.xxhash64(F.lit(j), "doc").alias("p"), "doc", "pos")) for j in range(pivots)))
    found = shared.groupBy("h").agg(F.count(F.lit(1)).alias("n"), first.alias("x")).where(F.col("n") > few)
    return materialize(found.select("h", F.array_distinct(F.transform("x", lambda x: F.struct(x["doc"].alias("doc"), x["pos"].alias("pos")))).alias("pivots")), "hot-seeds")


def pivot_links(hot: DataFrame, stats: DataFrame, most: int) -> DataFrame:
    """``(h, doc, pos, pdoc, ppos, bit)``: every occurrence of a hot seed with one in the document of each of its pivots (``stats`` of ``hot_seeds``; ``bit`` of the pivot).

    The nth occurrence in a document meets the pivot document's nth, counted round, so that what is linked of periodic texts lies on few diagonals, not on one each.
    """
    nth = F.row_number().over(Window.partitionBy("h", "doc").orderBy("pos")) - 1
    hot = materialize(hot.select("h", "doc", "pos").withColumn("nth", nth), "ranked-hot")
    pivots = stats.select("h", F.posexplode("pivots").alias("j", "v")).select("h", F.expr("shiftleft(1, j)").alias("bit"), F.col("v.doc").alias("doc"))
    places = hot.join(small(materialize(pivots, "pivot-docs"), 2 * most), ["h", "doc"]).groupBy("h", "bit", F.col("doc").alias("pdoc")).agg(F.array_sort(F.collect_list("pos")).alias("places"))
    met = hot.join(small(materialize(places, "pivot-places"), most), "h").where("doc <> pdoc")
    return met.select("h", "doc", "pos", "pdoc", F.get("places", F.pmod("nth", F.size("places"))).alias("ppos"), "bit")


def close_links(rows: DataFrame, *more: str) -> DataFrame:
    """All pairs of occurrences of a key in two documents, for keys known to have few: ``(h, doc, pos, odoc, opos)`` with doc > odoc, and ``more`` columns of both."""
    cols = ("doc", "pos", *more)
    other = rows.select("h", *(F.col(c).alias(f"o{c}") for c in cols))
    return rows.select("h", *cols).join(other, "h").where("doc > odoc")


def standing(hot_rows: DataFrame, star: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """``(h, doc, pos, stands)`` of all hot occurrences: bit j of ``stands`` says that the seed's pivot j stands for the occurrence.

    ``star`` links occurrences to those in the documents of pivots (``bit`` of each), ``spans`` are the passages found. A pivot stands for its own places that are linked, and for an
    occurrence when a passage of both texts holds the seed at both places.
    """
    cols = ("doc_id", "start_word", "n_words", "other_doc_id", "other_start_word", "other_n_words")
    names = ("x", "xs", "xn", "y", "ys", "yn")
    one = spans.select(*(F.col(c).alias(n) for c, n in zip(cols, names)))
    both = one.union(spans.select(*(F.col(c).alias(n) for c, n in zip(cols[3:] + cols[:3], names)))).withColumnsRenamed({"x": "doc", "y": "pdoc"})
    inside = F.col("pos").between(F.col("xs"), F.col("xs") + F.col("xn") - k) & F.col("ppos").between(F.col("ys"), F.col("ys") + F.col("yn") - k)
    held = star.join(both, ["doc", "pdoc"]).where(inside).select("h", "doc", "pos", "bit")
    own = star.select("h", F.col("pdoc").alias("doc"), F.col("ppos").alias("pos"), "bit")
    held = held.union(own).union(hot_rows.select("h", "doc", "pos", F.lit(0)))
    return held.groupBy("h", "doc", "pos").agg(F.bit_or("bit").alias("stands"))


#: Occurrences of a seed that a task compares with as many others at most.
TILE = 4096
#: Occurrences whose products with a tile are held at once.
_ROWS = 512
_BINS = 256
#: Pairs of occurrences that are aligned at once.
PAIRS = 8192


def _bags(words: np.ndarray) -> np.ndarray:
    """Rows of words (0: none) as counts in hashed bins. The product of two rows is at least the number of words in common, repeats included."""
    n, width = words.shape
    order = np.argsort(words, axis=1, kind="stable")
    sorted_words = np.take_along_axis(words, order, 1)
    new = np.ones(words.shape, bool)
    new[:, 1:] = sorted_words[:, 1:] != sorted_words[:, :-1]
    place = np.arange(width)[None, :]
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)  # a repeat is a word of its own
    bins = (mix(sorted_words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64)) % np.uint64(_BINS)).astype(np.int64)
    real = sorted_words != 0
    flat = (np.arange(n)[:, None] * _BINS + bins)[real]
    return np.bincount(flat, minlength=n * _BINS).reshape(n, _BINS).astype(np.float32)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Longest common subsequences of rows of words (0: none), row by row; 64 words of a row of x are the bits of one number."""
    n, width = x.shape
    if width > 64:
        best = np.zeros((n, y.shape[1] + 1), np.int16)
        for i in range(width):
            same = (y == x[:, i : i + 1]) & (x[:, i : i + 1] != 0)
            best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + same), axis=1)
        return best[:, -1].astype(int)
    row = np.full(n, (1 << width) - 1, np.uint64)
    full, packed = row.copy(), np.zeros((n, 8), np.uint8)
    for j in range(y.shape[1]):
        bits = np.packbits((x == y[:, j : j + 1]) & (y[:, j : j + 1] != 0), axis=1, bitorder="little")
        packed[:, : bits.shape[1]] = bits
        same = row & packed.view("<u8")[:, 0]
        row = ((row + same) | (row - same)) & full
    return width - np.bitwise_count(row).astype(int)


def context_links(docs: DataFrame, spots: DataFrame, k: int, reach: int, least: int) -> DataFrame:
    """``(h, doc, pos, odoc, opos, score, oscore)``, doc > odoc: all pairs of occurrences of a hot seed that no common pivot stands for and whose surroundings agree.

    ``spots`` has ``(h, doc, pos, stands)``. Surroundings are the ``reach`` words left and right of the seed; they agree when the longest common subsequences of both sides
    come to ``least`` words. Up to ``TILE`` occurrences of a seed meet in one cell, each once (side: ``stands`` + 2). Of more, those with equal ``stands`` are dealt into tiles of about ``TILE``, and tiles that
    may hold such pairs meet in a cell each (sides 0 and 1; a tile with itself: side 2): a task holds two tiles, whatever the seed's number of occurrences. In a cell, products of word counts reject most
    pairs, and each pair is looked at once. The scores of both places are the numbers of surrounding words that the seed holds, too.
    """
    seeds = spots.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.collect_set("stands").alias("all"))
    seeds = materialize(seeds.where((F.col("n") > 1) & F.exists("all", lambda x: F.exists("all", lambda y: x.bitwiseAND(y) == 0))), "seed-counts")
    apart = spots.join(small(seeds, BROADCAST_ROWS), "h").where(F.exists("all", lambda x: x.bitwiseAND(F.col("stands")) == 0))
    asked = materialize(apart.select("h", "stands", "doc", "pos", "n"), "asked-spots")
    read = lambda rows: with_words(docs, rows, "doc", F.col("pos") - reach, F.col("pos") + k + reach, "words")
    cols = ("cell", "h", "side", "doc", "pos", "words")
    met = read(asked.where(F.col("n") <= TILE)).withColumns({"cell": F.col("h"), "side": F.col("stands") + 2}).select(*cols)
    if not seeds.where(F.col("n") > TILE).isEmpty():
        large = asked.where(F.col("n") > TILE)
        sizes = materialize(large.groupBy("h", "stands").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "tile-counts")
        one = sizes.select("h", "stands", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
        other = one.select("h", F.col("stands").alias("stands2"), F.col("t").alias("t2"))
        ahead = (F.col("stands") < F.col("stands2")) | ((F.col("stands") == F.col("stands2")) & (F.col("t") <= F.col("t2")))
        cells = one.join(other, "h").where(ahead & (F.col("stands").bitwiseAND(F.col("stands2")) == 0))
        cells = cells.withColumn("cell", F.xxhash64("h", "stands", "t", "stands2", "t2"))
        own = (F.col("stands") == F.col("stands2")) & (F.col("t") == F.col("t2"))
        sides = cells.select("h", "stands", "t", "cell", F.when(own, 2).otherwise(0).alias("side")).union(cells.where(~own).select("h", "stands2", "t2", "cell", F.lit(1)))
        sides = materialize(sides, "tile-cells")
        dealt = large.join(sizes, ["h", "stands"]).withColumn("t", F.pmod(F.xxhash64("doc", "pos"), F.col("tiles")).cast("int"))
        met = met.union(materialize(read(dealt), "spot-words").join(sides, ["h", "stands", "t"]).select(*cols))

    def side_rows(pos, lists):
        offsets, values = np.asarray(lists.offsets), np.append(np.asarray(lists.values), np.int32(0))
        a, n, col = offsets[:-1, None], np.minimum(pos, reach)[:, None], np.arange(reach)[None, :]
        out = []
        for at, ok in ((col - reach + n, col >= reach - n), (col + n + k, col + n + k < np.diff(offsets)[:, None])):
            own = values[np.where(ok, a + at, -1)].astype(np.int64) + (1 << 32)  # never 0
            out.append(np.where(ok, own, 0))
        seed = values[a + n + np.arange(k)[None, :]].astype(np.int64) + (1 << 32)
        return *out, sum((x[:, :, None] == seed[:, None, :]).any(2).sum(1) for x in out)

    def compare(batches):
        """Rows sorted by cell and side. Products are made cell by cell, alignments for the pairs of many cells at once."""
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            cell = kept.column("cell").to_numpy()
            if kept.num_rows and cell[0] != cell[-1]:
                n = int(np.flatnonzero(cell != cell[-1])[-1]) + 1
                yield from found_in(kept.slice(0, n))
                kept = kept.slice(n)
        if kept is not None and kept.num_rows:
            yield from found_in(kept)

    def pieces(side):
        """Bounds of rows (at most ``_ROWS``) and of others in a cell, sorted by side, that are compared."""
        at = np.flatnonzero(np.append(True, side[1:] != side[:-1])).tolist()
        parts = [(int(side[x]), x, y) for x, y in zip(at, [*at[1:], len(side)])]
        for j, (s, x, y) in enumerate(parts):
            for t, o, p in parts[j:]:
                if (s < 2 and s < t) or (s >= 2 and not (s - 2) & (t - 2)):
                    for i in range(x, y, _ROWS):
                        yield i, min(i + _ROWS, y), i if s == t else o, p

    def found_in(table):
        cell, h, side, doc, pos = (table.column(c).to_numpy() for c in ("cell", "h", "side", "doc", "pos"))
        left, right, score = side_rows(pos, table.column("words").combine_chunks())
        new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        held, size = [], 0
        for a, b in zip(new.tolist(), np.append(new[1:], len(cell)).tolist()):
            bags = np.concatenate((_bags(left[a:b]), _bags(right[a:b])), axis=1)
            for i, m, o, p in pieces(side[a:b]):
                xs, ys = np.nonzero(bags[i:m] @ bags[o:p].T >= least)
                xs, ys = xs + i + a, ys + o + a
                once = (doc[xs] != doc[ys]) & ((xs < ys) | (o >= m))
                held.append((xs[once], ys[once]))
                size += int(once.sum())
                if size >= PAIRS:
                    yield agreeing(held, h, doc, pos, left, right, score)
                    held, size = [], 0
        if size:
            yield agreeing(held, h, doc, pos, left, right, score)

    def agreeing(held, h, doc, pos, left, right, score):
        xs, ys = (np.concatenate(x) for x in zip(*held))
        ok = [np.zeros(0, bool)]
        for i in range(0, len(xs), PAIRS):
            x, y = xs[i : i + PAIRS], ys[i : i + PAIRS]
            ok.append(_common(left[x], left[y]) + _common(right[x], right[y]) >= least)
        ok = np.concatenate(ok)
        xs, ys = xs[ok], ys[ok]
        swap = doc[xs] < doc[ys]
        hi, lo = np.where(swap, ys, xs), np.where(swap, xs, ys)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[xs], doc[hi], pos[hi], doc[lo], pos[lo], score[hi], score[lo])], ["h", "doc", "pos", "odoc", "opos", "score", "oscore"])

    found = met.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(compare, "h long, doc long, pos int, odoc long, opos int, score long, oscore long")
    return found


def agreement_pivots(agree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, others)``: the agreeing places of ``context_links`` parted into those of which one end is a pivot and all others.

    Every place names the agreeing place that is first in one global order, by falling score, then by document: a run of one word agrees with runs that are
    too short for a passage, too, and so names a long one of its like. Places that some other names are pivots (``up``: doc and pos, ``down``: odoc and opos).
    Places that all agree with each other so name the same two.
    """
    agree = materialize(agree, "agreeing")
    both = agree.select("doc", "pos", "odoc", "opos", "oscore").union(agree.select("odoc", "opos", "doc", "pos", "score"))
    named = both.groupBy("doc", "pos").agg(F.min(F.struct((-F.col("oscore")).alias("s"), F.xxhash64("odoc").alias("p"), "odoc", "opos")).alias("v"))
    named = small(materialize(named.select(F.col("v.odoc").alias("pdoc"), F.col("v.opos").alias("ppos")).distinct(), "named"), BROADCAST_ROWS)
    for side, doc, pos in (("up", "doc", "pos"), ("down", "odoc", "opos")):
        one = named.select(F.col("pdoc").alias(doc), F.col("ppos").alias(pos), F.lit(True).alias(side))
        agree = agree.join(one, [doc, pos], "left").withColumn(side, F.coalesce(side, F.lit(False)))
    agree = agree.select("h", "doc", "pos", "odoc", "opos", "up", "down")
    return agree.where("up or down"), agree.where("not up and not down")


#: Pivots of a place that are looked at, the first in the order of their hashes.
CLASSES = 16


def without_common_pivot(edges: DataFrame, others: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """Those of ``others`` that no pivot of ``edges`` stands for at both ends; see ``agreement_pivots``.

    A pivot stands for a place when a passage of ``spans`` holds the seed at both. It also stands for the places of its own document for which a pivot stands that stands for it.
    """
    cols = ("doc_id", "start_word", "n_words", "other_doc_id", "other_start_word", "other_n_words")
    names = ("doc", "xs", "xn", "odoc", "ys", "yn")
    inside = F.col("pos").between(F.col("xs"), F.col("xs") + F.col("xn") - k) & F.col("opos").between(F.col("ys"), F.col("ys") + F.col("yn") - k)
    held = edges.join(spans.select(*(F.col(c).alias(n) for c, n in zip(cols, names))), ["doc", "odoc"]).where(inside)
    one, other = F.xxhash64("doc", "pos"), F.xxhash64("odoc", "opos")
    pivots = edges.where("up").select("h", "doc", "pos", one.alias("c")).union(edges.where("down").select("h", "odoc", "opos", other)).distinct()
    members = held.where("down").select("h", "doc", "pos", other.alias("c")).union(held.where("up").select("h", "odoc", "opos", one)).union(pivots)
    members = materialize(members.distinct(), "members")
    standing_for = pivots.withColumnRenamed("c", "own").join(members, ["h", "doc", "pos"]).select("h", "doc", "c", "own")
    same = members.join(standing_for, ["h", "doc", "c"]).select("h", "doc", "pos", F.col("own").alias("c"))
    classes = members.union(same).groupBy("doc", "pos").agg(F.slice(F.array_sort(F.collect_set("c")), 1, CLASSES).alias("classes"))
    classes = small(materialize(classes, "classes"), BROADCAST_ROWS)
    ends = others.join(classes, ["doc", "pos"], "left").join(classes.select(F.col("doc").alias("odoc"), F.col("pos").alias("opos"), F.col("classes").alias("oclasses")), ["odoc", "opos"], "left")
    return ends.where(~F.coalesce(F.arrays_overlap("classes", "oclasses"), F.lit(False))).select("h", "doc", "pos", "odoc", "opos")


def _asked_of(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``docs`` that some request names: texts of others are not shuffled."""
    ids = materialize(requests.select(F.col("doc").alias("doc_id")).distinct(), "asked-ids")
    return docs.join(small(ids, BROADCAST_ROWS), "doc_id", "left_semi")


def context_grams(docs: DataFrame, spots: DataFrame, k: int, reach: int, size: int = 3) -> DataFrame:
    """``(h, doc, pos, at)``: for each seed occurrence in ``spots`` the places of the ``size``-word grams within ``reach`` words left and right of it; h joins seed and gram."""

    def run(batches):
        for batch in batches:
            for part in _list_chunks(batch, 3):
                words = Lists(part.column(3))
                grams, row = windows(words.h, size), window_texts(words, size, 0)
                h, doc, pos = (part.column(i).to_numpy() for i in range(3))
                near = np.arange(len(grams)) - words.first[row]
                seed = np.minimum(pos, reach)[row]
                ok = np.flatnonzero((row >= 0) & ((near + size <= seed) | (near >= seed + k)))
                of = row[ok]
                key = mix(h[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + grams[ok])
                at = pos[of] - seed[ok] + near[ok]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(doc[of]), pa.array(pos[of]), pa.array(at.astype(np.int32))], ["h", "doc", "pos", "at"])

    rows = with_words(docs, spots.select("h", "doc", "pos"), "doc", F.col("pos") - reach, F.col("pos") + k + reach, "words")
    return rows.mapInArrow(run, "h long, doc long, pos int, at int")


def fetch_words(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``(rid, side, words array<int>)``: 32-bit word hashes of the stretches ``(rid, side, doc, a, b)``, clipped to the text."""
    asked = requests.groupBy("doc").agg(F.collect_list(F.struct("rid", "side", "a", "b")).alias("asked"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 0):
                words = Words(part.column(0))
                small = (words.h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rid, side, got = [], [], []
                for lo, hi, wanted in zip(words.first[:-1].tolist(), words.first[1:].tolist(), part.column(1).to_pylist()):
                    own = small[lo:hi]
                    for r in wanted:
                        rid.append(r["rid"])
                        side.append(r["side"])
                        got.append(own[max(0, r["a"]) : max(0, r["b"])])
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(side, pa.int32()), pa.array(got, pa.list_(pa.int32()))], ["rid", "side", "words"])

    docs = _asked_of(docs, requests)
    with_text = docs.join(asked, docs["doc_id"] == asked["doc"]).select("text", "asked")
    return with_text.mapInArrow(run, "rid long, side int, words array<int>")
