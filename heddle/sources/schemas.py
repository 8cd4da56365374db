"""Schemas of the engine's tables; explicit types, no inference."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I, B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
TEXTS = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LANGS = ("en", "hi", "ta", "bn", "mr")
ELIGIBILITY = _struct(
    occupation=TEXTS, gender=S, bpl_required=B, land_ownership_required=B, girl_child_required=B, pregnant_woman_only=B, age_min=L, age_max=L,
    income_max_annual=S, caste_preference=TEXTS, bank_account_required=B, aadhaar_required=B, other_conditions=TEXTS,
)
FAQ = T.ArrayType(_struct(**{f"{part}_{lg}": S for lg in ("en", "hi", "ta") for part in ("question", "answer")}))
#: ``income_max_annual`` is read as text: numbers, prose and objects all occur there.
SCHEME = T.StructType([
    *_struct(id=S, **{f"name_{lg}": S for lg in LANGS}, **{f"description_{lg}": S for lg in LANGS}, **{f"benefit_{lg}": S for lg in LANGS}).fields,
    *_struct(eligibility_rules=ELIGIBILITY, exclusion_criteria=TEXTS, **{f"documents_{lg}": TEXTS for lg in LANGS}, **{f"apply_steps_{lg}": TEXTS for lg in LANGS}).fields,
    *_struct(keywords=TEXTS, related_schemes=TEXTS, tags=TEXTS, common_mistakes=TEXTS, pro_tips=TEXTS, faq=FAQ).fields,
    *_struct(state_wise_amounts=_struct(note=S, states=T.MapType(S, S)), state_specific_portals=_struct(note=S, portals=T.MapType(S, S))).fields,
    *_struct(application_url=S, helpline=S, ministry=S, nodal_department=S, scheme_type=S, last_updated=S, processing_time=S, payment_mode=S, payment_frequency=S, payment_schedule=S, source_url=S, launch_year=L, renewal_required=B, renewal_frequency=S, renewal_process=S).fields,
])
USAGE_EVENT = T.StructType([
    T.StructField("id", L), T.StructField("session_id", S, False), T.StructField("timestamp", T.TimestampType(), False), T.StructField("event_type", S, False),
    *_struct(call_type=S, model=S, prompt_tokens=L, completion_tokens=L, total_tokens=L, latency_ms=D, confidence=D, tavily_fired=I, tavily_error=S, guardrail_allowed=I, guardrail_stage=I, guardrail_reason=S, guardrail_matched=S, cache_hit=I, cache_type=S, query_text=S, extra_json=S).fields,
])
FACTS = _struct(occupation=S, gender=S, has_land=B, is_bpl=B, has_girl_child=B, is_pregnant=B, annual_income=L, state=S, age=L)
TURNS = T.ArrayType(_struct(role_user=S, role_bot=S, turn=I))
ENTITY_MEMORY = _struct(last_schemes_discussed=TEXTS, last_scheme_id=S, last_intent=S, resolved_references=T.MapType(S, S))
SESSION = T.StructType([
    T.StructField("id", S, False),
    *_struct(language=S, language_source=S, turn=I, confirmed_facts=FACTS, pending_slots=TEXTS, conversation_buffer=TURNS, entity_memory=ENTITY_MEMORY, eligibility_done=B, in_eligibility_flow=B, conversation_summary=S, last_slot_question=S, last_slot_asked=S, updated_at=T.TimestampType()).fields,
])
CACHE = T.StructType([
    T.StructField("cache_key", S, False), T.StructField("cache_type", S, False), T.StructField("call_type", S, False), T.StructField("response", S, False),
    T.StructField("lang", S), T.StructField("created_at", T.TimestampType(), False), T.StructField("expires_at", T.TimestampType(), False), T.StructField("hit_count", L),
])
EVENT = T.StructType([T.StructField("event_id", L), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", L), T.StructField("event_type", S), T.StructField("value", D), T.StructField("props", S)])
