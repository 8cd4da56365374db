"""Language by script, language codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .fixed import LANGUAGE_NAMES, MARATHI_WORDS

#: Code point ranges of the scripts.
SCRIPTS = {"ta": r"[\x{0B80}-\x{0BFF}]", "bn": r"[\x{0980}-\x{09FF}]", "hi": r"[\x{0900}-\x{097F}]", "te": r"[\x{0C00}-\x{0C7F}]", "kn": r"[\x{0C80}-\x{0CFF}]", "latin": "[A-Za-z]"}


def script_counts(c: Column) -> dict[str, Column]:
    return {k: F.regexp_count(c, F.lit(p)) for k, p in SCRIPTS.items()}


def language_by_script(c: Column) -> Column:
    """Language of texts in Indian scripts; null where the script does not tell (Latin or nearly so)."""
    n = script_counts(c)
    other = n["ta"] + n["bn"] + n["hi"] + n["te"] + n["kn"]
    hindi = F.when(F.arrays_overlap(text.words(c), F.array(*map(F.lit, sorted(MARATHI_WORDS)))), F.lit("mr")).otherwise(F.lit("hi"))
    top = F.greatest(n["ta"], n["bn"], n["hi"])
    return (
        F.when(c.isNull() | (other == 0) | ((other < 3) & (n["latin"] > 3 * other)), F.lit(None).cast("string"))
        .when(top == 0, F.lit("en"))
        .when(n["ta"] == top, F.lit("ta"))
        .when(n["bn"] == top, F.lit("bn"))
        .otherwise(hindi)
    )


#: Language names as models give them.
NAMED = {"english": "en", "hindi": "hi", "marathi": "mr", "bengali": "bn", "tamil": "ta", "hinglish": "hi"}


def language_code(raw: Column) -> Column:
    """One of the five codes from a code or a name; ``hi`` for all else."""
    c = F.lower(text.strip(raw))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv)), c)
    return F.when(c.isin(*LANGUAGE_NAMES), c).otherwise(F.coalesce(named, F.lit("hi")))


def language_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv))
    return F.coalesce(F.element_at(names, code), F.lit(LANGUAGE_NAMES["hi"]))


def settled_language(old: Column, old_source: Column, new: Column, new_source: Column) -> tuple[Column, Column]:
    """Language and its source after a message: a user's own choice is not overridden by detection."""
    held = (old_source == "user_selected") & (new_source != "user_selected")
    return F.when(held, old).otherwise(new), F.when(held, old_source).otherwise(new_source)
