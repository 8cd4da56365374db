"""Document quality rules, deterministic eligibility, checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialogue import amount
from ..sources.scratch import counted, stored
from .retrieval import documents_in


def _n(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _chars(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit("")))


def quality_issues() -> Column:
    """The issues of a scheme document, in rule order; an empty list is a pass. Without an FAQ both FAQ rules fire."""
    rules = [
        (_n("documents_en") < 8, "documents_en < 8"),
        (_n("apply_steps_en") < 8, "apply_steps_en < 8"),
        (_chars("helpline") == 0, "helpline missing"),
        (_chars("benefit_en") < 100, "benefit_en too short"),
        (_chars("name_hi") == 0, "name_hi missing"),
        (_chars("name_ta") == 0, "name_ta missing"),
        (_chars("description_en") < 150, "description_en too short"),
        (_n("exclusion_criteria") == 0, "exclusion_criteria missing"),
        (_n("keywords") < 15, "keywords < 15"),
        (F.col("eligibility_rules").isNull(), "eligibility_rules missing"),
        (_n("faq") == 0, "faq missing"),
        (_n("faq") < 5, "faq < 5 items"),
        (_n("documents_hi") == 0, "documents_hi missing"),
        (_n("apply_steps_hi") == 0, "apply_steps_hi missing"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in rules)))


#: Characters of each source that extraction reads.
SOURCE_LIMITS = {"search": 7000, "portal": 6000, "ministry": 6500, "short": 4000, "title": 800, "note": 600}


def cut(c: Column, source: str) -> Column:
    return F.substring(c, 1, SOURCE_LIMITS[source])


def income_limits(raw: Column) -> Column:
    """``array<struct<band, limit>>`` of an income limit given as number, prose or object; null when there is none."""
    banded = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("band"), F.coalesce(e["value"].try_cast("bigint"), amount(e["value"])).alias("limit")))
    plain = F.coalesce(raw.try_cast("double").cast("bigint"), amount(raw))
    single = F.array(F.struct(F.lit("all").alias("band"), plain.alias("limit")))
    return F.when(F.startswith(raw, F.lit("{")), banded).when(plain.isNotNull(), single)


def income_limit(raw: Column) -> Column:
    """The largest of an income limit's bands."""
    banded = F.array_max(F.transform(F.map_values(F.from_json(raw, "map<string,string>")), lambda v: F.coalesce(v.try_cast("bigint"), amount(v))))
    return F.when(F.startswith(raw, F.lit("{")), banded).otherwise(F.coalesce(raw.try_cast("double").cast("bigint"), amount(raw)))


def eligible(profile, rules) -> Column:
    """Whether a profile meets a scheme's rules. ``profile(name)`` and ``rules(name)`` give columns; ``income_limit`` is the largest limit, parsed.

    A null rule does not constrain; an unknown fact is no ground to refuse (ambiguous counts as eligible); occupations match generously.
    """
    jobs = rules("occupation")
    job = profile("occupation")
    def need(rule: str, fact: str) -> Column:
        return ~F.coalesce(rules(rule) & ~profile(fact), F.lit(False))

    limits = rules("income_limit")
    gender = F.lower(rules("gender"))
    fits = [
        jobs.isNull() | (F.size(jobs) == 0) | F.arrays_overlap(jobs, F.array(F.lit("any"), F.lit("all"))) | job.isNull() | F.array_contains(jobs, job),
        gender.isNull() | (gender == "any") | (gender == "all") | profile("gender").isNull() | (gender == F.lower(profile("gender"))),
        need("bpl_required", "is_bpl"), need("land_ownership_required", "has_land"), need("girl_child_required", "has_girl_child"), need("pregnant_woman_only", "is_pregnant"),
        limits.isNull() | (profile("annual_income") <= limits), profile("age") >= rules("age_min"), profile("age") <= rules("age_max"),
    ]
    out = F.lit(True)
    for f in fits:
        out = out & F.coalesce(f, F.lit(True))
    return out


#: Profiles and rules meet on a grid of 2**LEVELS by 2**LEVELS leaves of age and income.
LEVELS = 4
AGE_STEP, INCOME_STEP = 8, 50_000


def _leaf(value: Column, step: int) -> Column:
    """The leaf of a value, null for null; the last one has no end."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(2**LEVELS - 1), F.floor(value / step))).cast("int"))


def point_leaf(age: Column, income: Column) -> Column:
    """The leaf ``(a, i)`` of a profile, null where either is unknown."""
    return F.when(age.isNotNull() & income.isNotNull(), F.struct(_leaf(age, AGE_STEP).alias("a"), _leaf(income, INCOME_STEP).alias("i")))


def point_bins(leaf: Column) -> Column:
    """The square that holds a leaf at each level, from the whole grid down to itself."""
    a, i = leaf["a"], leaf["i"]
    return F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright(a, LEVELS - n).alias("a"), F.shiftright(i, LEVELS - n).alias("i")) for n in range(LEVELS + 1)))


def area_leaves(age_min: Column, age_max: Column, income_max: Column) -> Column:
    """The leaves ``(low, high, top)`` of ``[age_min, age_max] x (-inf, income_max]``; null bounds are open."""
    last = F.lit(2**LEVELS - 1)
    return F.struct(F.coalesce(_leaf(age_min, AGE_STEP), F.lit(0)).alias("low"), F.coalesce(_leaf(age_max, AGE_STEP), last).alias("high"), F.coalesce(_leaf(income_max, INCOME_STEP), last).alias("top"))


def area_bins(leaves: Column) -> Column:
    """The fewest squares that cover an area's leaves; a profile within lies in just one of them."""
    low, high, top = leaves["low"], leaves["high"], leaves["top"]

    def inside(n: int, a: Column, i: Column) -> Column:
        side = 2 ** (LEVELS - n)
        return (a * side >= low) & (a * side + (side - 1) <= high) & (i * side + (side - 1) <= top)

    def squares(n: int) -> Column:
        def square(k: Column) -> Column:
            a, i = F.shiftright(k, n), k.bitwiseAND(2**n - 1)
            whole = inside(n, a, i)
            return F.when(whole & ~inside(n - 1, F.shiftright(a, 1), F.shiftright(i, 1)) if n else whole, F.struct(F.lit(n).alias("level"), a.alias("a"), i.alias("i")))

        return F.transform(F.sequence(F.lit(0), F.lit(4**n - 1)), square)

    return F.array_compact(F.concat(*(squares(n) for n in range(LEVELS + 1))))


def _job(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def match(profiles: DataFrame, schemes: DataFrame) -> DataFrame:
    """``(profile_id, id)`` of eligible pairs, each once: a range join on squares of age and income, and on the occupation.

    A scheme stands under each occupation it names, or as open to all; and under "any" for profiles without one. Profiles look under their own and the open ones, or under "any".
    Within these, a scheme lies in the squares that cover its age and income range, a profile in one square a level; profiles whose age or income is unknown meet all schemes of
    their occupation. What squares leave open is checked on the pair. Income limits are parsed once a scheme; schemes are broadcast when they were counted to be few.
    """
    e = F.col("eligibility_rules")
    jobs = F.array_distinct(F.array_compact(e["occupation"]))
    open_to_all = e.isNull() | e["occupation"].isNull() | (F.size(e["occupation"]) == 0) | F.arrays_overlap(e["occupation"], F.array(F.lit("any"), F.lit("all"))) | F.exists(e["occupation"], lambda j: j.isNull())
    named = F.when(F.coalesce(open_to_all, F.lit(False)), F.array(_job("open", F.lit("")))).otherwise(F.transform(jobs, lambda j: _job("one", j)))
    right = schemes.select("id", "eligibility_rules", income_limit(e["income_max_annual"]).alias("income_limit"))
    unknown = F.struct(F.lit(-1).alias("level"), F.lit(0).alias("a"), F.lit(0).alias("i"))
    right = right.withColumn("_job", F.explode(F.concat(named, F.array(_job("any", F.lit(""))))))
    right = right.withColumn("_area", area_leaves(e["age_min"], e["age_max"], F.col("income_limit")))
    right = right.withColumn("_bin", F.explode(F.concat(area_bins(F.col("_area")), F.array(unknown)))).drop("_area")
    right = counted(stored(right, "scheme-bins"), SCHEME_BINS)
    left = profiles.withColumn("_job", F.explode(F.when(F.col("occupation").isNull(), F.array(_job("any", F.lit("")))).otherwise(F.array(_job("one", F.col("occupation")), _job("open", F.lit(""))))))
    left = left.withColumn("_leaf", point_leaf(F.col("age"), F.col("annual_income")))
    left = left.withColumn("_bin", F.explode(F.when(F.col("_leaf").isNull(), F.array(unknown)).otherwise(point_bins(F.col("_leaf")))))
    fits = eligible(lambda n: F.col(n), lambda n: F.col("income_limit") if n == "income_limit" else F.col("eligibility_rules")[n])
    return left.join(right, (left["_job"] == right["_job"]) & (left["_bin"] == right["_bin"]) & fits).select("profile_id", "id")


#: Rows of schemes by occupation and square that are broadcast at most.
SCHEME_BINS = 100_000


def checklist(schemes: DataFrame, ids: DataFrame, lang: str = "en") -> DataFrame:
    """One row a document of the eligible schemes, numbered, with what a printed checklist shows."""
    own = schemes.join(ids, "id", "left_semi").withColumn("docs", documents_in(F.lit(lang)))
    return own.select("id", F.col("name_en"), F.substring("benefit_en", 1, 120).alias("benefit"), F.transform(F.slice("apply_steps_en", 1, 3), lambda s: F.substring(s, 1, 100)).alias("steps"), "helpline", "application_url", F.posexplode("docs").alias("pos", "document")).withColumn("pos", F.col("pos") + 1)


def sms_text(schemes: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: the checklist as a short message, schemes by id."""
    line = F.concat(F.coalesce("name_en", F.lit("")), F.lit(": "), F.substring(F.coalesce("benefit_en", F.lit("")), 1, 80), F.lit("\nDocs: "), F.coalesce(F.array_join(F.slice("documents_en", 1, 3), ", "), F.lit("")))
    rows = schemes.join(ids, "id", "left_semi").select("id", line.alias("line"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("x")).select(F.array_join(F.transform("x", lambda r: r["line"]), "\n\n").alias("sms"))


def eligible_text(rows: DataFrame) -> DataFrame:
    """One row: eligible schemes (name_en, benefit_en, reason, documents, url, helpline) as blocks of text, or None."""
    def v(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    block = F.concat(F.lit("SCHEME: "), v("name_en"), F.lit("\nBENEFIT: "), v("benefit_en"), F.lit("\nWHY ELIGIBLE: "), v("reason"), F.lit("\nKEY DOCUMENTS: "), F.coalesce(F.array_join(F.slice("documents", 1, 4), ", "), F.lit("")), F.lit("\nURL: "), v("url"), F.lit("\nHELPLINE: "), v("helpline"))
    out = rows.agg(F.sort_array(F.collect_list(F.struct("id", block.alias("b")))).alias("x"))
    return out.select(F.when(F.size("x") == 0, F.lit("None")).otherwise(F.array_join(F.transform("x", lambda r: r["b"]), "\n\n")).alias("text"))


def ineligible_text(rows: DataFrame, most: int = 5) -> DataFrame:
    line = F.concat(F.lit("- "), F.coalesce("name_en", F.lit("")), F.lit(": "), F.coalesce("reason", F.lit("")))
    out = rows.orderBy("id").limit(most).agg(F.sort_array(F.collect_list(F.struct("id", line.alias("b")))).alias("x"))
    return out.select(F.when(F.size("x") == 0, F.lit("None")).otherwise(F.array_join(F.transform("x", lambda r: r["b"]), "\n")).alias("text"))
