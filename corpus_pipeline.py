"""A training corpus from raw documents: quality, repeated lines, near duplicates, privacy, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before it kept, and returns a DataFrame; all but the last
return the columns of ``documents``, with ``n_chars`` of the new text. Null and repeated ids are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import jaccard, line_dedup, packing, pii, quality_classifier
from heddle.llm.common import materialize, table
from heddle.llm.entry import PII_KEY, vocabulary

#: No SQL: the fitted classifier, the keyed surrogates and the tokeniser cannot be expressed; tests compare with brute force.
ORACLE_SQL = None


def _sized(before: DataFrame, after: DataFrame) -> DataFrame:
    after = after.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in before.columns else after
    return after.select(*before.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    return quality_classifier.drop_rejected(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds."""
    return _sized(docs, line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return jaccard.drop_near_duplicates(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets."""
    return _sized(docs, pii.anonymise(docs, PII_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences."""
    return packing.pack(docs, vocabulary()).drop("cost")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("privacy", privacy), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
