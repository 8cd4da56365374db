"""Message classification and slot extraction as one plan around a model's reply: prompt, call, lenient reading, override by script, clean-up.

The model is a boundary (``models.asked``); all that follows its reply are columns. Replies that cannot be read count as empty objects, so every message gets a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dialogue, language, text
from . import models


def facts_of(reply: Column, path: str = "$.new_facts") -> Column:
    """The facts of a reply as a map of strings; nulls and empty strings are no facts, nor is anything but an object."""
    found = F.try_variant_get(reply, path, "map<string,variant>")
    said = F.transform_values(F.coalesce(found, F.create_map().cast("map<string,variant>")), lambda _, v: F.try_variant_get(v, "$", "string"))
    return F.map_filter(said, lambda _, v: v.isNotNull() & (v != ""))


def classified(messages: DataFrame, raw: Column, message: Column, known_language: Column, in_flow: Column) -> DataFrame:
    """``messages`` with ``language, language_source, intent, new_facts, scheme_mentioned, resolved_query`` from the model's ``raw`` reply.

    The script of a message is definitive; then the session's language, then what the model says. An unknown intent gives way to the word rules. A query that the model
    did not rewrite is the message.
    """
    reply = F.col("_reply")
    script = language.language_by_script(message)
    known = F.when(known_language != "", known_language)
    named = F.coalesce(F.try_variant_get(reply, "$.language", "string"), F.lit("hi"))
    query = F.try_variant_get(reply, "$.resolved_query", "variant")
    out = messages.withColumn("_reply", text.response_json(F.coalesce(raw, F.lit("")))).withColumns({
        "language": F.coalesce(script, known, language.language_code(named)),
        "language_source": F.when(script.isNotNull(), "script_detected").when(known.isNotNull(), "session").otherwise("auto_detected"),
        "intent": dialogue.valid_intent(F.try_variant_get(reply, "$.intent", "string"), message, in_flow),
        "new_facts": facts_of(reply), "scheme_mentioned": F.try_variant_get(reply, "$.scheme_mentioned", "string"),
        "resolved_query": F.when(query.isNull(), message).otherwise(F.try_variant_get(reply, "$.resolved_query", "string")),
    })
    return out.drop("_reply")


def slot_value(raw: Column, slot: Column) -> Column:
    """What a reply says about ``slot``, as text: booleans and words for them as true and false; null where extraction failed."""
    v = F.try_variant_get(text.response_json(F.coalesce(raw, F.lit(""))), F.concat(F.lit("$."), slot), "variant")
    said = F.try_variant_get(v, "$", "string")
    worded = F.when(F.schema_of_variant(v) == "STRING", dialogue.truth(said))
    return F.coalesce(worded.cast("string"), said)


def classify(messages: DataFrame, prompt: Column, factories: list, known_language: Column, in_flow: Column, message: str = "text", **how) -> DataFrame:
    """The whole call: models are asked in turn, with retries; a message whose models all failed is classified by the rules alone, with ``model_error``."""
    asked = models.asked(messages, prompt, factories, "_asked", **how)
    return classified(asked, F.col("_asked.reply"), F.col(message), known_language, in_flow).withColumn("model_error", F.col("_asked.error")).drop("_asked")


def extract_slot(messages: DataFrame, prompt: Column, factories: list, slot: Column, out: str = "value", **how) -> DataFrame:
    """A slot's value from free-text replies."""
    asked = models.asked(messages, prompt, factories, "_asked", **how)
    return asked.withColumn(out, slot_value(F.col("_asked.reply"), slot)).drop("_asked")
