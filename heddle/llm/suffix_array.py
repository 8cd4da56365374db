"""Repeated passages across documents by a sparse suffix array.

Suffixes count that start a passage of ``least`` words which another text may hold. A first sort of suffixes at content-selected (minimiser)
positions finds them: with seeds of ``k`` words and windows of ``least - k + 1`` seeds, any passage of ``least`` words holds a kept seed, at the same place
in every copy, so only the ``least - k + 1`` suffixes that reach over a seed of two texts take part. These are sorted by their first ``least`` words in one
distributed sort and compared with their neighbours: whoever is the neighbour holds the whole passage, and a passage of m documents costs m
comparisons a word, not m squared. Equal neighbours on one diagonal join to one stretch, which is then extended to the left and to the right
until a word differs or a text ends, so each row is a maximal match of its two texts.

Result: rows ``(doc_id, start_word, n_words, other_doc_id, other_start_word, is_copy)``: words start_word ... of doc_id equal
(A-Z folded) those of the other document; ``is_copy`` when the other has the smaller id. Exact copies of a whole text are reported against the
smallest doc_id of their text. A passage is covered by several rows when its neighbours change along the way; every word of every passage of ``least``
words that two different texts share is in some row.

Defined cases. Null ids or texts and texts of fewer than ``least`` words: no rows. Repeats inside one document only: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small
from .seeds import distinct_texts, fetch_words, neighbours, seed_rows, window_texts
from .words import Words, chunks, windows


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(a))


def passage_rows(docs: DataFrame, spots: DataFrame, least: int, k: int) -> DataFrame:
    """``(h, doc, pos)``: hashes of the ``least`` words from each position on, where they reach over a seed of ``spots`` (doc, pos)."""
    asked = spots.groupBy("doc").agg(F.collect_set("pos").alias("asked"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                words = Words(part.column(1))
                h, text = windows(words.h, least), window_texts(words, least, least)
                lists = part.column(2)
                of = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                at = words.first[of] + lists.flatten().to_numpy(zero_copy_only=False)
                wanted = np.zeros(len(words.h) + 2, np.int32)
                np.add.at(wanted, np.maximum(at - (least - k), words.first[of]), 1)
                np.add.at(wanted, at + 1, -1)
                spot = np.flatnonzero((np.cumsum(wanted)[: len(h)] > 0) & (text >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(h[spot].astype(np.int64)), part.column(0).take(pa.array(text[spot])), pa.array((spot - words.first[text[spot]]).astype(np.int32))], ["h", "doc", "pos"])

    with_text = docs.join(asked, docs["doc_id"] == asked["doc"]).select("doc_id", "text", "asked")
    return with_text.mapInArrow(run, "h long, doc long, pos int")


#: Words of a block whose hash stands for them while a long match is followed.
BLOCK = 128


def block_hashes(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``(rid, side, hashes array<long>)``: hashes of the whole blocks of words from place ``a`` on to the text's end, or back to its start where ``back``."""
    asked = requests.groupBy("doc").agg(F.collect_list(F.struct("rid", "side", "a", "back")).alias("asked"))

    def batch_of(rows: list) -> pa.RecordBatch:
        rid, side, got = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(side, pa.int32()), pa.array(got, pa.list_(pa.int64()))], ["rid", "side", "hashes"])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 0):
                words = Words(part.column(0))
                held, size = [], 0
                for lo, hi, wanted in zip(words.first[:-1].tolist(), words.first[1:].tolist(), part.column(1).to_pylist()):
                    own = windows(words.h[lo:hi], BLOCK).astype(np.int64) if hi - lo >= BLOCK else np.zeros(0, np.int64)
                    for r in wanted:
                        got = own[r["a"] - BLOCK :: -BLOCK] if r["back"] and r["a"] >= BLOCK else own[:0] if r["back"] else own[r["a"] :: BLOCK]
                        held.append((r["rid"], r["side"], got))
                        size += len(got)
                        if size > 1 << 20:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    ids = materialize(requests.select(F.col("doc").alias("doc_id")).distinct(), "asked-ids")
    some = docs.join(small(ids), "doc_id", "left_semi")
    with_text = some.join(asked, some["doc_id"] == asked["doc"]).select("text", "asked")
    return with_text.mapInArrow(run, "rid long, side int, hashes array<long>")


def _ends(live: DataFrame, request) -> DataFrame:
    """Requests at the open ends of both documents; ``request(end, at)`` gives their columns, sides are 0 and 1 of doc and 2 and 3 of odoc."""
    out = None
    for i, (doc, shift) in enumerate((("doc", F.lit(0)), ("odoc", F.col("diag")))):
        for j, (end, at) in enumerate((("left", "a"), ("right", "b"))):
            one = live.where(end).select("rid", F.lit(2 * i + j).alias("side"), F.col(doc).alias("doc"), *request(end, F.col(at) - shift))
            out = one if out is None else out.union(one)
    return out


def extended(docs: DataFrame, stretches: DataFrame, least: int) -> DataFrame:
    """``stretches`` (rid, doc, odoc, diag, a, b) with both ends moved out to the last word that matches, in at most three steps.

    The next ``least`` words beside each end settle nearly all. Ends that are still open compare hashes of whole blocks to the end of the texts, an eighth of a byte a word, and then the
    words of the first block that differs.
    """
    live = stretches.select("rid", "doc", "odoc", "diag", "a", "b", F.lit(True).alias("left"), F.lit(True).alias("right"))

    def moved(got: DataFrame, column: str, unit: int, full: int | None, turned: bool) -> DataFrame:
        """Ends moved by what matches; with ``full`` they stay open where so many do."""
        # Left words come in text order, so both extensions are common prefixes once they are reversed. Repeated rows give the same words: any of them serves.
        wide = got.groupBy("rid").pivot("side", [0, 1, 2, 3]).agg(F.first(column))
        left = _common(F.reverse("0"), F.reverse("2")) if turned else _common(F.col("0"), F.col("2"))
        n = wide.select("rid", F.coalesce(left, F.lit(0)).alias("l"), F.coalesce(_common(F.col("1"), F.col("3")), F.lit(0)).alias("r"))
        open_ = [(F.col(c) == full).alias(e) if full else F.col(e) for c, e in (("l", "left"), ("r", "right"))]
        return materialize(live.join(n, "rid").select("rid", "doc", "odoc", "diag", (F.col("a") - F.col("l") * unit).alias("a"), (F.col("b") + F.col("r") * unit).alias("b"), *open_), "extended")

    def beside(n: int):
        return lambda end, at: [(at - n).alias("a"), at.alias("b")] if end == "left" else [at.alias("a"), (at + n).alias("b")]

    first = moved(fetch_words(docs, _ends(live, beside(least))), "words", 1, least, True)
    closed, live = first.where("not left and not right"), first.where("left or right")
    if not live.isEmpty():
        live = moved(block_hashes(docs, _ends(live, lambda end, at: [at.alias("a"), F.lit(end == "left").alias("back")])), "hashes", BLOCK, None, False)
        closed = closed.unionByName(moved(fetch_words(docs, _ends(live, beside(BLOCK))), "words", 1, None, True))
    return closed.drop("left", "right")


def repeated_passages(docs: DataFrame, least: int = 50, k: int = 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one, copies = distinct_texts(docs)
    w = least - k + 1
    if not 0 < w <= k:
        raise ValueError("k must be over half of least: seeds a window apart have to cover the words between them")
    rows = materialize(seed_rows(one, k, w, least, repeats=True), "suffixes")
    spots = materialize(neighbours(rows).select("doc", "pos"), "spots")
    hits = neighbours(passage_rows(one, spots, least, k)).withColumn("diag", F.col("pos") - F.col("opos"))
    by = Window.partitionBy("doc", "odoc", "diag").orderBy("pos")
    hits = hits.withColumn("new", (F.col("pos") - F.lag("pos").over(by) > least).cast("int")).withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(by))
    stretch = hits.groupBy("doc", "odoc", "diag", "part").agg(F.min("pos").alias("a"), (F.max("pos") + least).alias("b"))
    stretch = materialize(stretch.withColumn("rid", F.xxhash64("doc", "odoc", "diag", "part")), "stretches")
    full = extended(one, stretch, least).withColumnsRenamed({"a": "start", "b": "stop"})
    found = full.select(F.col("doc").alias("doc_id"), F.col("start").cast("long").alias("start_word"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"), F.col("odoc").alias("other_doc_id"), (F.col("start") - F.col("diag")).cast("long").alias("other_start_word"))
    long_copies = docs.join(copies.withColumnRenamed("doc_id", "copy"), docs["doc_id"] == F.col("copy")).select("doc_id", F.lit(0).cast("long").alias("start_word"), F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long").alias("n_words"), F.col("rep").alias("other_doc_id"), F.lit(0).cast("long").alias("other_start_word"))
    both = found.unionByName(long_copies.where(F.col("n_words") >= least)).distinct()
    return both.withColumn("is_copy", F.col("other_doc_id") < F.col("doc_id"))


def cut_copies(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that an earlier document holds; the words that stay are joined by single spaces where something went."""
    names = docs.columns
    spans = passages.where("is_copy").groupBy(F.col("doc_id").alias("__hd_d")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("__hd_s"))
    gone = F.flatten(F.transform("__hd_s", lambda s: F.sequence(s["start_word"], s["start_word"] + s["n_words"] - 1)))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    out = docs.join(spans, docs[id_col] == spans["__hd_d"], "left").withColumn("__hd_w", F.when(F.col("__hd_s").isNotNull(), words))
    stay = F.array_except(F.transform(F.sequence(F.lit(0), F.size("__hd_w") - 1), lambda i: i.cast("long")), gone)
    return out.withColumn(text_col, F.when(F.col("__hd_s").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__hd_w", i.cast("int"))), " "))).select(*names)
