"""Line de-duplication on the native engine: first occurrences of line keys, returned as compressed keep bitmaps.

Method. Lines become ``(key hash, document, position)`` records without text. The records are range-partitioned by key and sorted within by document
and position; a running first over that stream tells each record the first document of its key, so later records drop where they are, without a
join. Keys with more than ``HOT`` records, or a ten-thousandth of all (so 10,000 keys at most), are dealt over ``SALTS`` streams by document first, and the
first documents of those streams are put together. Documents then get
sparse 64-line words of kept bits: a word that is not listed is all ones, so a document that loses nothing
carries no bitmap at all.

Defined cases. Null or empty text: one empty line, kept. Null doc_id: the row takes no part and keeps all lines.
Rows that repeat a doc_id: occurrences in one document never drop each other; each row gets its own bitmap.
Keys shorter than ``min_chars`` code points never drop. Extra columns of any name pass through ``dedup_lines`` untouched; names that begin with
``__hd_`` are reserved in ``apply_bitmaps``.
Key equality is by two independently seeded 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialize

HOT = 100_000
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else kept; pure ASCII takes the engine's fast ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return fold_ascii(F.trim(line, F.lit(WHITE)))


def _row_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with other text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_records(docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    """One row a line with a key that can drop: ``(k1, k2, doc, rk, pos)``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), _row_key(F.col(text_col)).alias("rk"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), "key").alias("k2"), "doc", "rk", "pos")


def later_occurrences(records: DataFrame, hot: int = HOT) -> DataFrame:
    """The records whose key an earlier document holds: ``(doc, rk, pos)``."""
    limit = max(hot, records.count() // 10_000)
    busy = records.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    busy = F.broadcast(busy.select("k1", "k2", F.lit(True).alias("hot")))  # 10,000 rows at most
    dealt = records.join(busy, ["k1", "k2"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("k1", "k2", "salt").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, 0)
    stream = dealt.repartitionByRange(parts, "k1", "k2", "salt").withColumn("first_doc", F.first("doc").over(order))
    marked = materialize(stream.where(F.col("hot") | (F.col("doc") > F.col("first_doc"))), "later-lines")
    heads = marked.where("hot").groupBy("k1", "k2").agg(F.min("first_doc").alias("hot_first"))
    out = marked.join(F.broadcast(heads), ["k1", "k2"], "left")  # 10,000 rows at most
    return out.where(F.col("doc") > F.coalesce("hot_first", "first_doc")).select("doc", "rk", "pos")


def keep_bitmaps(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 10, hot: int = HOT) -> DataFrame:
    """Per row that loses lines: ``(doc, rk, n_dropped, keep)``.

    ``keep`` is an array of ``(word, bits)`` for the 64-line words with a dropped line: bit b of word w is 1
    when line 64 * w + b stays.
    """
    records = materialize(line_records(docs, text_col, id_col, min_chars), "line-keys")
    drops = later_occurrences(records, hot)
    words = drops.groupBy("doc", "rk", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    words = words.withColumn("n", F.bit_count("gone").cast("long"))
    return words.groupBy("doc", "rk").agg(F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set; linear in the number of lines."""
    gone = F.flatten(F.transform(keep, lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * 64 + b)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(keep.isNull(), lines).otherwise(F.transform(stay, lambda i: F.get(lines, i)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``__hd_lines`` (all lines), ``__hd_kept`` (those that stay) and ``__hd_dropped`` (how many went)."""
    marks = bitmaps.select(F.col("doc").alias("__hd_doc"), F.col("rk").alias("__hd_rk"), F.col("n_dropped").alias("__hd_dropped"), F.col("keep").alias("__hd_keep"))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    out = docs.join(marks, (docs[id_col] == marks["__hd_doc"]) & (_row_key(docs[text_col]) == marks["__hd_rk"]), "left")
    out = out.withColumn("__hd_lines", lines).withColumn("__hd_kept", kept_lines(F.col("__hd_lines"), F.col("__hd_keep")))
    return out.withColumn("__hd_dropped", F.coalesce("__hd_dropped", F.lit(0).cast("long"))).drop("__hd_doc", "__hd_rk", "__hd_keep")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 10) -> DataFrame:
    """``docs`` with the text that stays; all other columns as they are. A null text stays null."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*cols).alias("__hd_row"), F.col(f"`{id_col}`").alias("__hd_id"), F.col(f"`{text_col}`").alias("__hd_text"))
    done = apply_bitmaps(packed, keep_bitmaps(packed, "__hd_text", "__hd_id", min_chars), "__hd_text", "__hd_id")
    text = F.when(F.col("__hd_dropped") > 0, F.array_join("__hd_kept", "\n")).otherwise(F.col("__hd_text"))
    return done.select(*((text if c == text_col else F.col("__hd_row")[c]).alias(c) for c in docs.columns))
