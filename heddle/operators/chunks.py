"""Nested documents to searchable chunks: one generator over an array of conditional structs, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import counted, stored


def _t(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _list(c: str, sep: str = ", ") -> Column:
    return F.coalesce(F.array_join(c, sep), F.lit(""))


def _shown(c: str) -> Column:
    """A value as templates print it: None, True, False, or the text."""
    s = F.col(c).cast("string")
    return F.coalesce(F.when(s.isin("true", "false"), F.initcap(s)).otherwise(s), F.lit("None"))


def _object_shown(c: str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(c, r"\s*\n\s*", ""), F.lit('"'), F.lit("'")), r":(?=\S)", ": "), r",(?=\S)", ", ")
    return F.coalesce(F.when(F.startswith(F.col(c), F.lit("{")), s).otherwise(F.col(c)), F.lit("None"))


def _full(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _said(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def _templates() -> list[tuple[str, Column | None, list]]:
    """(type, condition or always, parts after the prefix); parts are texts or columns. Fixed wording, in chunk order."""
    e = "eligibility_rules."
    name, name_hi = _t("name_en"), F.coalesce(F.col("name_hi"), _t("name_en"))
    states = F.filter(F.transform(F.map_entries("state_wise_amounts.states"), lambda x: F.when(F.coalesce(x["value"], F.lit("")) != "", F.concat(x["key"], F.lit(": "), x["value"]))), lambda x: x.isNotNull())

    def local(lg: str, word: str) -> list:
        return [_t(f"name_{lg}"), " — ", _t(f"description_{lg}"), f" {word}: ", F.coalesce(F.nullif(F.col(f"benefit_{lg}"), F.lit("")), _t("benefit_en"))]

    return [
        ("overview", None, [name, " — Overview: ", _t("description_en"), " Benefit: ", _t("benefit_en"), " Ministry: ", _t("ministry"), " Keywords: ", _list("keywords")]),
        ("benefit", None, [name, " — Benefits and amount: ", _t("benefit_en"), " | हिंदी: ", _t("benefit_hi")]),
        ("eligibility", None, [
            name, " — Eligibility criteria: Occupation: ", _list(e + "occupation"), " | Gender: ", F.coalesce(F.col(e + "gender"), F.lit("any")), " | BPL required: ", _shown(e + "bpl_required"),
            " | Land ownership required: ", _shown(e + "land_ownership_required"), " | Age: ", _shown(e + "age_min"), "-", _shown(e + "age_max"), " | Income max: ₹", _object_shown(e + "income_max_annual"),
            " | Aadhaar required: ", _shown(e + "aadhaar_required"), " | Other conditions: ", _list(e + "other_conditions", "; "),
        ]),
        ("exclusion", _list("exclusion_criteria", "; ") != "", [name, " — Who CANNOT apply / exclusion criteria: ", _list("exclusion_criteria", "; ")]),
        ("documents", _full("documents_en"), [name, " — Documents required (English): ", _list("documents_en")]),
        ("hindi_docs", _full("documents_hi"), [name_hi, " — आवश्यक दस्तावेज़: ", _list("documents_hi")]),
        ("tamil", _full("documents_ta"), [name, " — Documents required (Tamil): ", _list("documents_ta")]),
        ("bengali", _full("documents_bn"), [name, " — Documents required (Bengali): ", _list("documents_bn")]),
        ("marathi", _full("documents_mr"), [name, " — Documents required (Marathi): ", _list("documents_mr")]),
        ("apply", _full("apply_steps_en"), [name, " — How to apply (steps): ", _list("apply_steps_en", "; "), " Apply URL: ", _t("application_url")]),
        ("hindi_apply", _full("apply_steps_hi"), [name_hi, " — आवेदन कैसे करें: ", _list("apply_steps_hi", "; ")]),
        ("hindi", _said("name_hi"), [_t("name_hi"), " — ", _t("description_hi"), " लाभ: ", _t("benefit_hi")]),
        ("tamil", _said("name_ta") & _said("description_ta"), local("ta", "நன்மை")),
        ("bengali", _said("name_bn") & _said("description_bn"), local("bn", "সুবিধা")),
        ("marathi", _said("name_mr") & _said("description_mr"), local("mr", "फायदा")),
        ("state_wise", F.coalesce(F.size(states), F.lit(0)) > 0, [name, " — State-wise benefit amounts (", F.coalesce(F.col("state_wise_amounts.note"), F.lit("varies by state")), "): ", F.array_join(F.slice(states, 1, 20), "; ")]),
        ("metadata", None, [name, " — Helpline: ", _t("helpline"), " | Apply at: ", _t("application_url"), " | Ministry: ", _t("ministry"), " | Launch year: ", _t("launch_year"), " | Processing time: ", _t("processing_time")]),
        ("renewal", _said("renewal_process"), [name, " — Renewal information: Required: ", _shown("renewal_required"), " | ", _t("renewal_process")]),
        ("keywords", _full("keywords"), [name, " — Search keywords: ", _list("keywords")]),
        ("related", _full("related_schemes"), [name, " — Related schemes: ", _list("related_schemes")]),
        ("mistakes", _full("common_mistakes"), [name, " — Common mistakes to avoid: ", _list("common_mistakes", "; ")]),
    ]


def build_chunks(schemes: DataFrame, order: str = "file_key") -> DataFrame:
    """``(order, scheme_id, pos, chunk_type, text)`` in emission order; blank texts are skipped."""
    prefix = F.concat(F.lit("passage: [SCHEME:"), _t("id"), F.lit("] "))

    def chunk(kind: str, when: Column | None, parts: list) -> Column:
        made = F.struct(F.lit(kind).alias("chunk_type"), F.concat(prefix, *(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))
        return made if when is None else F.when(when, made)

    def has(x: Column, *names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (F.coalesce(x[n], F.lit("")) != "")
        return out

    def question(x: Column) -> Column:
        hi = F.when(has(x, "question_hi", "answer_hi"), F.concat(F.lit(" | हिंदी: प्र: "), x["question_hi"], F.lit(" उ: "), x["answer_hi"])).otherwise(F.lit(""))
        ta = F.when(has(x, "question_ta", "answer_ta"), F.concat(F.lit(" | தமிழ்: கே: "), x["question_ta"], F.lit(" ப: "), x["answer_ta"])).otherwise(F.lit(""))
        return F.struct(F.lit("faq").alias("chunk_type"), F.concat(prefix, _t("name_en"), F.lit(" — FAQ: Q: "), x["question_en"], F.lit(" A: "), x["answer_en"], hi, ta).alias("text"))

    faq = F.transform(F.filter(F.coalesce(F.col("faq"), F.array().cast(schemes.schema["faq"].dataType)), lambda x: has(x, "question_en", "answer_en")), question)
    every = F.concat(F.array_compact(F.array(*(chunk(*t) for t in _templates()))), faq)
    rows = schemes.select(F.col(order).alias("file_key"), F.col("id").alias("scheme_id"), F.posexplode(every).alias("pos", "c"))
    return rows.select("file_key", "scheme_id", "pos", "c.chunk_type", "c.text").where(text.strip(F.col("text")) != "")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, scheme_id, chunk_type, text)``: of equal texts the first stays; ids count from 0 in order.

    Ids come from one global order, so the last step is a single sorted pass over ids and keys only where the corpus is small
    (hundreds of chunks); ``with_ids`` is the form for large corpora.
    """
    kept = keep_first(chunks, F.md5("text"), "file_key", "pos")
    return with_ids(kept, "file_key", "pos").select("chunk_id", "scheme_id", "chunk_type", "text")


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """Of rows with an equal key the first in order. The aggregate sees keys and order only; rows are then picked by both, so that a key with many rows is no hot spot."""
    rows = df.withColumn("_key", key)
    first = rows.groupBy("_key").agg(F.min(F.struct(*order)).alias("_f")).where("_key is not null")
    first = counted(stored(first.select(F.col("_key").alias("_k"), *(F.col(f"_f.{c}").alias(f"_o{i}") for i, c in enumerate(order))), "first-rows"))
    same = rows["_key"] == first["_k"]
    for i, c in enumerate(order):
        same = same & rows[c].eqNullSafe(first[f"_o{i}"])
    return rows.join(first, same, "left_semi").drop("_key")


def with_ids(df: DataFrame, *order: str) -> DataFrame:
    """Consecutive ids in global order without a single-task sort: ranks inside range partitions plus the sizes of those before.

    The partitions are stored once, so that their numbers mean the same in both branches.
    """
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranged")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_base"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row a partition.
    return parts.join(F.broadcast(before.select("_p", "_base", "_before")), "_p").withColumn("chunk_id", F.col("_before") + F.col("_m") - F.col("_base")).drop("_p", "_m", "_base", "_before")


def type_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chunk_type")
