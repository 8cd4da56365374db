"""Eligibility as a range join against all pairs, and the squares it meets on."""

import random

from pyspark.sql import functions as F

from heddle.operators import rules
from heddle.sources.schemas import ELIGIBILITY

PROFILE = "profile_id long, occupation string, gender string, has_land boolean, is_bpl boolean, has_girl_child boolean, is_pregnant boolean, annual_income long, age int"


def fits(p, r, limit):
    if r is None:
        return True
    job, jobs = p["occupation"], r["occupation"]
    if not (jobs is None or not jobs or {"any", "all"} & set(jobs) or None in jobs or job is None or job in jobs):
        return False
    g = (r["gender"] or "any").lower()
    if not (g in ("any", "all") or p["gender"] is None or p["gender"].lower() == g):
        return False
    for rule, fact in (("bpl_required", "is_bpl"), ("land_ownership_required", "has_land"), ("girl_child_required", "has_girl_child"), ("pregnant_woman_only", "is_pregnant")):
        if r[rule] and p[fact] is False:
            return False
    for low, value, high in ((r["age_min"], p["age"], r["age_max"]), (None, p["annual_income"], limit)):
        if value is not None and ((low is not None and value < low) or (high is not None and value > high)):
            return False
    return True


def test_match_is_all_pairs_that_fit(spark):
    rng = random.Random(7)
    jobs = ["farmer", "student", "*", "?", "any", ""]
    flag = lambda: rng.choice([None, True, False])
    people = [(i, rng.choice([None, *jobs]), rng.choice([None, "male", "Female"]), flag(), flag(), flag(), flag(), rng.choice([None, -5, 0, rng.randrange(900_000), 10**9]), rng.choice([None, -1, rng.randrange(130), 500])) for i in range(400)]
    schemes, limits = [], {}
    for i in range(60):
        limit = rng.choice([None, 0, 49_999, 50_000, 250_000, 799_999, 5_000_000])
        limits[f"s{i}"] = limit
        rule = {f.name: None for f in ELIGIBILITY.fields} | {
            "occupation": rng.choice([None, [], ["any"], [None, "farmer"], *[[rng.choice(jobs) for _ in range(3)] for _ in range(6)]]), "gender": rng.choice([None, "any", "female", "Male"]), "income_max_annual": None if limit is None else str(limit),
            "age_min": rng.choice([None, 0, 17, 18, 60, 127, 300]), "age_max": rng.choice([None, 5, 18, 40, 64, 200]), **{k: flag() for k in ("bpl_required", "land_ownership_required", "girl_child_required", "pregnant_woman_only")},
        }
        schemes.append((f"s{i}", None if i == 9 else rule))
    left = spark.createDataFrame(people, PROFILE)
    right = spark.createDataFrame([(i, None if r is None else tuple(r[f.name] for f in ELIGIBILITY.fields)) for i, r in schemes], "id string, eligibility_rules " + ELIGIBILITY.simpleString())
    got = [tuple(r) for r in rules.match(left, right).collect()]
    want = {(p["profile_id"], i) for p in left.collect() for i, r in schemes if fits(p, r, None if r is None else limits[i])}
    assert len(got) == len(set(got)) and set(got) == want
    plan = rules.match(left, right)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_point_lies_in_one_square_of_an_area(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(-3, 140, 5)]), rng.choice([None, *range(0, 150, 7)]), rng.choice([None, 0, 10_000, 333_333, 10**8])) for i in range(300)]
    areas = spark.createDataFrame(rows, "i int, low int, high int, top long").select("*", rules.area_bins(rules.area_leaves(F.col("low"), F.col("high"), F.col("top"))).alias("area"))
    points = spark.createDataFrame([(a, n) for a in range(0, 140, 9) for n in (-1, 0, 49_999, 50_000, 420_000, 10**9)], "age int, income long").select("*", rules.point_bins(rules.point_leaf(F.col("age"), F.col("income"))).alias("bins"))
    both = areas.crossJoin(points).select("*", F.size(F.array_intersect("area", "bins")).alias("n"))
    seen = set()
    for r in both.collect():
        within = (r["low"] is None or r["age"] >= r["low"]) and (r["high"] is None or r["age"] <= r["high"]) and (r["top"] is None or r["income"] <= r["top"])
        seen.add((r["low"] is None, r["high"] is None, r["top"] is None, within))
        assert r["n"] <= 1 and (r["n"] == 1 or not within)
    assert {(True, False, False, True), (False, True, False, True), (False, False, True, True)} <= seen
    assert max(len(r["area"]) for r in areas.collect()) <= 70
