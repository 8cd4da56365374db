"""Dialogue rules as columns: intents, routes, slots, buttons, commands, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .fixed import BINARY_SLOTS, NO_WORDS, OCCUPATION_BUTTONS, YES_WORDS

#: The slots in asking order, with their profile labels.
SLOTS = {
    "occupation": "Occupation",
    "gender": "Gender",
    "has_land": "Owns agricultural land",
    "is_bpl": "Has BPL ration card",
    "has_girl_child": "Has girl child under 10",
    "is_pregnant": "Pregnant/recently delivered woman in household",
    "annual_income": "Annual household income",
    "state": "State",
    "age": "Age",
}
FEMALE_OCCUPATIONS = ("women hoh", "woman hoh", "woman_hoh", "female farmer", "female labourer", "female laborer")
INTENTS = ("eligibility_check", "scheme_query", "document_query", "how_to_apply", "general_info", "slot_fill_response", "off_topic")
#: Words of the last-resort intent rules, in order of precedence.
YES_PARTS = ("yes", "हाँ", "haan", "ha", "ஆம்", "হ্যাঁ", "होय", "ji")
NO_PARTS = ("no", "नहीं", "nahi", "இல்லை", "না", "नाही", "nope", "nhi")
INTENT_WORDS = {
    "document_query": ("document", "kागज", "दस्तावेज", "aadhaar", "papers"),
    "how_to_apply": ("apply", "आवेदन", "application", "how to", "steps"),
    "eligibility_check": ("eligible", "पात्र", "qualify", "which scheme", "कौन सी"),
}
QUESTION_SIGNS = ("?", "kya", "what", "how", "why", "when", "where", "which", "क्या", "कैसे", "कब", "कहाँ", "कौन", "என்ன", "எப்படி", "কি", "কেন", "batao", "bataiye", "tell me", "explain")


def intent_by_words(message: Column, in_flow: Column) -> Column:
    """Intent by substrings; inside the dialogue any yes or no part is a reply (so "ha" in "what" is one)."""
    low = text.strip(F.lower(message))
    out = F.when(in_flow & text.contains_any(low, YES_PARTS + NO_PARTS), F.lit("slot_fill_response"))
    for intent, parts in INTENT_WORDS.items():
        out = out.when(text.contains_any(low, parts), F.lit(intent))
    return out.otherwise(F.lit("scheme_query"))


def valid_intent(intent: Column, message: Column, in_flow: Column) -> Column:
    """A model's intent when it is a known one, else the rule's."""
    return F.when(intent.isin(*INTENTS), intent).otherwise(intent_by_words(message, in_flow))


def intent_route(intent: Column) -> Column:
    return F.when(intent == "eligibility_check", "start_flow").when(intent.isin("scheme_query", "document_query", "how_to_apply"), "retrieval").otherwise("general")


def confidence_route(confidence: Column, sure: float = 0.65, fair: float = 0.50) -> Column:
    """Live search by retrieval confidence: none, added to the answer, or in its place."""
    return F.when(confidence >= sure, "none").when(confidence >= fair, "enhance").otherwise("live")


def looks_like_question(message: Column) -> Column:
    return text.contains_any(text.strip(F.lower(message)), QUESTION_SIGNS)


def _implied_female(facts: Column) -> Column:
    return F.coalesce(F.lower(facts["occupation"]).isin(*FEMALE_OCCUPATIONS), F.lit(False))


def with_implied_gender(facts: Column) -> Column:
    """Facts where an occupation that implies it has set the gender."""
    return facts.withField("gender", F.when(facts["gender"].isNull() & _implied_female(facts), F.lit("female")).otherwise(facts["gender"]))


def next_slot(facts: Column) -> Column:
    """The first slot without a fact, in order; null when the profile is complete."""
    ask = [F.when(facts[s].isNull() & (~_implied_female(facts) if s == "gender" else F.lit(True)), F.lit(s)) for s in SLOTS]
    return F.coalesce(*ask)


def pending_slots(facts: Column) -> Column:
    return F.array_compact(F.array(*(F.when(facts[s].isNull(), F.lit(s)) for s in SLOTS)))


def button_needs(facts: Column, in_flow: Column, done: Column) -> tuple[Column, Column]:
    """Whether yes/no buttons and whether occupation buttons are due."""
    slot, active = next_slot(facts), in_flow & ~done
    return active & F.coalesce(slot.isin(*sorted(BINARY_SLOTS)), F.lit(False)), active & F.coalesce(slot == "occupation", F.lit(False))


def button_reply(message: Column, facts: Column, in_flow: Column, done: Column) -> Column:
    """``(slot, value, gender)`` of replies that need no model: occupation buttons, yes/no to a binary slot; else null."""
    low = text.strip(F.lower(message))
    kinds = F.create_map(*(F.lit(x) for label, kind in OCCUPATION_BUTTONS.items() for x in (label.lower(), kind)))
    kind = F.element_at(kinds, low)
    slot = next_slot(facts)
    open_slot = in_flow & ~done & F.coalesce(slot.isin(*sorted(BINARY_SLOTS)), F.lit(False))

    def reply(s: Column, v: Column, g: Column) -> Column:
        return F.struct(s.alias("slot"), v.alias("value"), g.cast("string").alias("gender"))

    none = F.lit(None)
    return (
        F.when(kind.isNotNull(), reply(F.lit("occupation"), kind, F.when(kind == "woman_hoh", F.lit("female"))))
        .when(open_slot & low.isin(*sorted(YES_WORDS)), reply(slot, F.lit("true"), none))
        .when(open_slot & low.isin(*sorted(NO_WORDS)), reply(slot, F.lit("false"), none))
    )


def truth(value: Column) -> Column:
    low = F.lower(text.strip(value))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def merged_facts(old: Column, new: Column) -> Column:
    """Old facts overlaid by new ones; nulls and empty strings never overwrite. Both are maps of strings."""
    given = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull() & (v != ""))
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


def profile_text(facts: Column) -> Column:
    """Known facts, one labelled line each, booleans as Yes and No."""
    lines = []
    for slot, label in SLOTS.items():
        v = facts[slot].cast("string")
        shown = F.when(v == "true", "Yes").when(v == "false", "No").otherwise(v) if slot in BINARY_SLOTS else v
        lines.append(F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), shown)))
    body = F.array_join(F.array_compact(F.array(*lines)), "\n")
    return F.when(body == "", F.lit("No profile information collected yet.")).otherwise(body)


#: Text menus and what their numbers mean.
OCCUPATION_NUMBERS = {"1": "🌾 farmer", "2": "👷 labourer", "3": "👩 woman hoh", "4": "📚 student"}
YES_NO_NUMBERS = {"1": "✅ yes", "2": "❌ no"}
RESET_WORDS = ("reset", "start", "restart", "new", "begin", "शुरू", "नया", "start over", "शुरुवात", "புதிய", "নতুন", "नव्याने", "नए सिरे")
LANGUAGE_WORDS = {"hindi": "hi", "हिंदी": "hi", "1": "hi", "tamil": "ta", "தமிழ்": "ta", "2": "ta", "bengali": "bn", "বাংলা": "bn", "3": "bn", "marathi": "mr", "मराठी": "mr", "4": "mr", "english": "en", "5": "en"}
ELIGIBILITY_WORDS = ("check", "eligibility", "पात्रता", "योजना जाँच", "எனக்கு தகுதி", "আমার যোগ্যতা", "पात्रता तपासणी", "which schemes", "kaunsi yojana")


def numbered_reply(message: Column, facts: Column, in_flow: Column, done: Column) -> Column:
    """A bare number as the button it stands for while a menu is open; all else as it is."""
    yes_no, job = button_needs(facts, in_flow, done)
    t = text.strip(message)
    jobs = F.create_map(*(F.lit(x) for kv in OCCUPATION_NUMBERS.items() for x in kv))
    answers = F.create_map(*(F.lit(x) for kv in YES_NO_NUMBERS.items() for x in kv))
    return F.coalesce(F.when(job, F.element_at(jobs, t)), F.when(yes_no, F.element_at(answers, t)), message)


def menu_appended(reply: Column, facts: Column, in_flow: Column, done: Column, lang: Column, occupation_menu: dict[str, str], yes_no_menu: dict[str, str]) -> Column:
    """A slot question with the menu that it needs, in the user's language or English."""
    yes_no, job = button_needs(facts, in_flow, done)
    menus = {"job": occupation_menu, "yes_no": yes_no_menu}
    pick = F.when(job, F.lit("job")).when(yes_no, F.lit("yes_no"))
    return F.when(pick.isNotNull(), F.concat(reply, F.lit("\n\n"), text.localised(menus, pick, lang))).otherwise(reply)


def command(message: Column) -> Column:
    """What a channel message asks for: reset, language:<code>, eligibility, or a run of the assistant."""
    low = text.strip(F.lower(message))
    codes = F.create_map(*(F.lit(x) for kv in LANGUAGE_WORDS.items() for x in kv))
    return (
        F.when(low.isin(*RESET_WORDS), F.lit("reset"))
        .when(F.element_at(codes, low).isNotNull(), F.concat(F.lit("language:"), F.element_at(codes, low)))
        .when(low.isin(*ELIGIBILITY_WORDS), F.lit("eligibility"))
        .otherwise(F.lit("run"))
    )


#: Amount words.
UNITS = {"k": 1_000, "thousand": 1_000, "hazar": 1_000, "hazaar": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000}
NUMBER_WORDS = {"ek": 1, "one": 1, "do": 2, "two": 2, "teen": 3, "three": 3, "char": 4, "four": 4, "paanch": 5, "five": 5}
NO_INCOME = r"(?i)\b(?:no|don'?t have(?: any)?|zero|nil) income\b"


def amount(c: Column) -> Column:
    """Rupees of a spoken or written amount ("2 lakhs", "50k", "Rs 2.5 lakh", "do lakh"); null without one."""
    low = F.replace(F.lower(c), F.lit(","), F.lit(""))
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    spoken = "|".join(NUMBER_WORDS)
    scale = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    value = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    number, unit = F.regexp_extract(low, rf"(\d+(?:\.\d+)?)\s*({units})?\b", 1), F.regexp_extract(low, rf"(\d+(?:\.\d+)?)\s*({units})?\b", 2)
    word, word_unit = F.regexp_extract(low, rf"\b({spoken})\s+({units})\b", 1), F.regexp_extract(low, rf"\b({spoken})\s+({units})\b", 2)
    digits = F.round(number.try_cast("double") * F.coalesce(F.element_at(scale, unit), F.lit(1))).try_cast("long")
    said = (F.element_at(value, word) * F.element_at(scale, word_unit)).cast("long")
    return F.when(F.regexp_like(c, F.lit(NO_INCOME)), F.lit(0).cast("long")).when(number != "", digits).when(word != "", said)
