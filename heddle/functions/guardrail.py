"""The message guardrail as one lazy expression: (allowed, reason, stage, matched, message)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .fixed import ABUSE, INJECTION, OFFTOPIC, REFUSALS, SAFE_REPLIES, TOPIC_WORDS


def _any_of(patterns: list[str]) -> str:
    """Alternatives for Java: case-blind, dot over lines, Unicode classes."""
    return "(?isU)" + "|".join(patterns)


def refusal(reason: Column, lang: Column) -> Column:
    return text.localised(REFUSALS, reason, lang, default="en", default_key="offtopic")


def check(message: Column, in_flow: Column, lang: Column, on_topic: Column | None = None) -> Column:
    """The cascade. ``in_flow``: an eligibility dialogue is open; ``on_topic``: a model's verdict for
    messages that no rule decides (null or absent: let pass). ``stage`` is 2 where the verdict decided."""
    msg = text.strip(message)
    low = F.lower(msg)
    n = text.word_count(msg)
    hit = {k: text.first_match(low, _any_of(p)) for k, p in (("injection", INJECTION), ("abuse", ABUSE), ("offtopic", OFFTOPIC))}

    def verdict(allowed: bool, reason: str | None = None, stage: int | None = None, matched: Column | None = None) -> Column:
        return F.struct(
            F.lit(allowed).alias("allowed"),
            F.lit(reason).cast("string").alias("reason"),
            F.lit(stage).cast("int").alias("stage"),
            (matched if matched is not None else F.lit(None)).cast("string").alias("matched"),
            (refusal(F.lit(reason), lang) if reason else F.lit(None)).cast("string").alias("message"),
        )

    blocked = {k: verdict(False, k, 1, m) for k, m in hit.items()}
    result = F.when((msg == "__init__") | low.isin(*sorted(SAFE_REPLIES)), verdict(True))
    result = result.when(in_flow & (n <= 6) & hit["injection"].isNull(), verdict(True))
    for kind in ("injection", "abuse", "offtopic"):
        result = result.when(hit[kind].isNotNull(), blocked[kind])
    result = result.when(text.contains_any(low, TOPIC_WORDS) | (n <= 3), verdict(True))
    if on_topic is not None:
        result = result.when(~F.coalesce(on_topic, F.lit(True)), verdict(False, "offtopic", 2))
    return result.otherwise(verdict(True))


def undecided(message: Column, in_flow: Column) -> Column:
    """Whether only a model can decide: filter on this before any Python model call, as Python runs for every row it sees."""
    low = F.lower(text.strip(message))
    n = text.word_count(low)
    ruled = (low == "__init__") | low.isin(*sorted(SAFE_REPLIES)) | (in_flow & (n <= 6)) | F.regexp_like(low, F.lit(_any_of(INJECTION + ABUSE + OFFTOPIC))) | text.contains_any(low, TOPIC_WORDS) | (n <= 3)
    return ~ruled
