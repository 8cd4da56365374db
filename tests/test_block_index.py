"""The block index against plain BM25: same lists, fewer blocks, stored and read again."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import block_index, retrieval


def corpus(spark, n=900, seed=2):
    """Three vocabularies with a common core; a few chunks are full of one rare word."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = i % 3
        words = [f"{'abc'[kind]}{'xyzuvw'[rng.randrange(6)] * (1 + rng.randrange(4))}" if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(rng.randrange(40))]
        words += ["rare"] * rng.randrange(1, 6) if i % 97 == 0 else []
        rows.append((i, " ".join(words), f"t{kind}"))
    return spark.createDataFrame([*rows, (2000, None, "t0"), (2001, "", None), (2002, "1 2 3", "t1")], "chunk_id long, text string, chunk_type string")


def asked(spark):
    return spark.createDataFrame([(1, "rare"), (2, "the of and"), (3, "axx the bzz"), (4, "cuu cuu cuu rare"), (5, "absent"), (6, ""), (7, None), (8, "ayyy"), (9, "the")], "query_id long, text string")


@pytest.mark.parametrize("k, bits, first", [(20, 3, 2), (1, 5, 1), (200, 4, 3), (3, 0, 8)])
def test_same_as_scoring_everything(spark, k, bits, first):
    index = block_index.build(corpus(spark), ("chunk_type",), bits=bits)
    got, blocks = block_index.search(index, asked(spark), k, first=first)
    want = retrieval.top_ranked(retrieval.bm25_scores(corpus(spark), asked(spark)), k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    read = {r["query_id"]: (r["scored"], r["blocks"]) for r in blocks.collect()}
    assert set(read) == {1, 2, 3, 4, 8, 9} and all(a <= b for a, b in read.values())
    if k <= 3:
        assert read[4][0] < read[4][1] and read[3][0] < read[3][1]


def test_index_is_stored_and_read(spark, tmp_path):
    index = block_index.build(corpus(spark), ("chunk_type",), bits=4)
    block_index.write(index, str(tmp_path / "ix"))
    back = block_index.read(spark, str(tmp_path / "ix"))
    got = block_index.search(back, asked(spark), 5)[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, block_index.search(index, asked(spark), 5)[0].collect()))
    assert back.stats.first()["n"] == 903 and back.terms.where("term = 'rare'").first()["df"] == 10
    top = index.blocks.agg(F.min("top"), F.max(F.size("offsets"))).first()
    assert top[0] > 0 and top[1] <= 16


def test_empty_corpus(spark):
    index = block_index.build(corpus(spark).where("false"))
    assert block_index.search(index, asked(spark), 5)[0].count() == 0


def test_scores_of_a_block_stay_where_its_postings_are(spark):
    """Posting lists move once, by block; rows of single scores are not shuffled."""
    index = block_index.build(corpus(spark), ("chunk_type",), bits=4)
    weights = block_index._weights(index, asked(spark))
    chosen = weights.join(index.blocks, "term").select("query_id", "block").distinct()
    scores = block_index._scores(index, weights, chosen, 6)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert scores.count() > 0 and "hashpartitioning(query_id, block" not in plan.split("collect_set")[0] and "hashpartitioning(query_id, chunk_id" not in plan
