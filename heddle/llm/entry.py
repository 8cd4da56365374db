"""Queries of the training-data operators, by name, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_job, chaining, jaccard, line_dedup, packing, pii, quality_classifier, quality_rules, repair, suffix_array, topk, vector_dedup, whitening
from .common import table


def vocabulary() -> str:
    """The vocabulary file of the production queries; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).drop("cost")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_job.digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_passages(table(spark, sf_dir, "documents"))


def op7_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for either document of a passage, so that each has its passages under its own id."""
    found = chaining.fuzzy_passages(table(spark, sf_dir, "documents"))
    cols = ("doc_id", "start_word", "n_words", "other_doc_id", "other_start_word", "other_n_words")
    sides = F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(own, cols))) for own in (cols, cols[3:] + cols[:3])))
    return found.select(F.explode(sides).alias("s"), "matched_words", "identity").select("s.*", "matched_words", "identity")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The key of the production query; a deployment passes its own secret.
PII_KEY = b"heddle demonstration key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.anonymise(docs, PII_KEY, count_col="n_entities").select("doc_id", "n_entities", "text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    digest = F.sha2(F.array_join("__hd_kept", "\n"), 256)
    return done.select("doc_id", F.size("__hd_lines").cast("long").alias("n_lines"), F.col("__hd_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    done = quality_rules.judge(docs, labels)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", F.array_join("rejected_by", ",").alias("rejected_by"))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_topk, op3_jaccard_join, op4_suffix_array, op5_line_dedup, op6_quality_rules, op7_chaining, op8_quality_classifier, op9_pii, op10_bpe, op11_vector_dedup, op12_whitening, op13_repair)}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as sql

    return sql()
