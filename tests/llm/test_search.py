"""Exact top-k against brute force, with ties, gaps and awkward vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from heddle.llm import topk


def brute(rows, k, is_query, scale=64):
    cand = []
    for i, v in rows:
        if i is None or v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        q = tuple(math.floor(scale * x) for x in v)
        if (i, q) not in cand:
            cand.append((i, q))
    out = set()
    for i in {i for i, _ in cand if is_query(i)}:
        own = min(q for j, q in cand if j == i)
        scored = sorted((-sum(a * b for a, b in zip(own, q)), j) for j, q in cand if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    half = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(160)]
    fine = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(160, 260)]
    hot = [(i, [0.5, 0.5, 0.0, 0.0, 0.25, 0.0]) for i in range(300, 380)]
    odd = [(400, None), (420, [None, 1.0]), (440, [float("nan")]), (460, [float("inf"), 0.0]), (480, []), (500, [1.0, 1.0]), (520, [0.25] * 9), (None, [0.5] * 6), (0, half[0][1]), (20, [0.75] * 6), (541, [1e12, 0.0])]
    return half + fine + hot + odd


@pytest.mark.parametrize("k, blocks", [(20, (2048, 16384)), (7, (4, 16)), (1, (3, 50)), (1000, (9, 70))])
def test_topk(spark, rows, k, blocks):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit(1).alias(c) for c in ("v", "cb", "rank", "score")))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, query_block=blocks[0], candidate_block=blocks[1], bucket_bits=4)
    assert {tuple(r) for r in got.collect()} == brute(rows, k, lambda i: i % 20 == 0)


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 20 == 0).count() == 0


def test_topk_of_long_vectors(spark):
    """Thousands of components, in double and in long arithmetic."""
    rng = random.Random(9)
    for top in (1.0, 2e9):
        rows = [(i, [rng.uniform(-top, top) for _ in range(4000)]) for i in range(45)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, query_block=2, candidate_block=10)
        assert {tuple(r) for r in got.collect()} == brute(rows, 5, lambda i: i % 20 == 0) if top == 1.0 else got.count() == 15
