"""Near-duplicate vectors against all pairs, with families, awkward rows, and the calibrations behind the recall."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import oracles, vector_dedup

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    items = list({(i, None if v is None else tuple(v), label) for i, v, label in rows})
    whole = [np.array(v, float) if v and i is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for i, v, label in items]
    unit = [None if v is None else v / np.linalg.norm(v) for v in whole]
    near = {k: [] for k in range(len(items))}
    for a in range(len(items)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and items[a][2] == items[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                near[a].append(b)
                near[b].append(a)
    out = []
    for a in range(len(items)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((items[b][0] for b in seen), key=lambda x: (x is not None, x or 0))
        out.append((items[a][0], len(near[a]), least, items[a][0] == least))
    return sorted(out, key=repr)


def family(rng, ids, base, noise, label):
    return [(i, [float(np.float32(x + rng.gauss(0, noise))) for x in base], label) for i in ids]


def given(seed=1, d=24):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(d)], i % 3) for i in range(250)]
    rows += family(rng, range(1000, 1160), base[0], 0.12, 1)  # many pairs on either side of the threshold
    rows += family(rng, range(2000, 2020), base[1], 0.02, 2) + [(3000 + i, base[2], 0) for i in range(40)] + [(3100, [2 * x for x in base[2]], 0), (3101, base[2], 1)]
    rows += family(rng, range(4000, 4030), base[3], 0.1, None) + [(3000, base[2], 0)] * 3
    rows += [(5000, None, 1), (5001, [None] * d, 1), (5002, [float("nan")] * d, 1), (5003, [0.0] * d, 1), (5004, [], 1), (5005, [1.0], 1), (5006, [2.0], 1), (5007, [-1.0], 1), (None, base[0], 1), (5008, [1e-30] * d, 4), (5009, [1e30] * d, 4)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]


@pytest.mark.parametrize("sizes", [{}, {"block": 40}, {"block": 30, "copy_cost": 0.5}])
def test_matches_all_pairs(spark, sizes):
    rows = given()
    df = spark.createDataFrame(rows, ROWS).select("*", *(F.lit(1).alias(c) for c in ("node", "code", "table", "d", "n", "own")))
    if "copy_cost" in sizes:
        assert vector_dedup.bits(250, 0.98, 5e-7, sizes["copy_cost"]) > 2
    got = sorted((tuple(r) for r in vector_dedup.near_duplicates(df, **sizes).collect()), key=repr)
    assert got == brute(rows)


def test_given_table_matches_sql(spark, same):
    same("op11", lambda s, d: vector_dedup.near_duplicates(s.read.parquet(f"{d}/embeddings.parquet")), oracles.OP11)


def test_empty_and_alone(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0
    assert [tuple(r) for r in vector_dedup.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0], 1)], ROWS)).collect()] == [(3, 0, 3, True)]


@pytest.mark.parametrize("d", [2, 3, 8, 64, 768])
def test_windows_and_counts_are_calibrated(d):
    rng = np.random.default_rng(2)
    reach = math.sqrt(0.04)
    for chance in (0.5, 0.9, 0.99):
        a = rng.normal(size=(40_000, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        inside = np.mean(np.abs(a[:, 0]) * reach <= vector_dedup.window(d, reach, chance))
        assert abs(inside - chance) < 0.01
    assert vector_dedup.window(1, reach, 0.5) == reach
    need = vector_dedup.least_count(16, 0.99, 5e-7)
    lost = [sum(math.comb(16, c) * 0.99**c * 0.01 ** (16 - c) for c in range(k)) for k in (need, need + 1)]
    assert lost[0] <= 5e-7 < lost[1]


def test_tables_meet_as_often_as_they_should():
    rng = np.random.default_rng(3)
    d, angle = 64, math.acos(0.98)
    for k in (1, 6, 12):
        count = vector_dedup.tables(k, 0.98, 0.01)
        lost, a = 0, rng.normal(size=(2000, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(2000, d))
        b -= (a * b).sum(1, keepdims=True) * a
        b = math.cos(angle) * a + math.sin(angle) * b / np.linalg.norm(b, axis=1, keepdims=True)
        way = vector_dedup.directions(d, k * count, 1)
        x, y = ((v @ way > 0).reshape(2000, count, k) for v in (a, b))
        lost = np.mean(~(x == y).all(2).any(1))
        assert lost <= 0.025
    assert vector_dedup.bits(5000, 0.98, 5e-7, 4096) == 0 < vector_dedup.bits(10**7, 0.98, 5e-7, 4096)
