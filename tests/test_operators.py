"""Operators on small literal tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import chunks, retrieval, rules, state, usage
from heddle.sources import readers, sinks
from heddle.sources.schemas import CACHE, SCHEME, USAGE_EVENT


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("schemes")
    full = {
        "id": "alpha", "name_en": "Alpha", "name_hi": "अल्फा", "description_en": "D", "benefit_en": "B", "eligibility_rules": {"occupation": ["farmer"], "gender": "female", "bpl_required": True, "age_min": 18, "income_max_annual": {"EWS": 300000, "LIG": "6 lakh"}},
        "documents_en": ["one", "two"], "documents_hi": ["एक"], "apply_steps_en": ["go"], "keywords": ["k1", "k2"], "state_wise_amounts": {"states": {"Goa": "Rs 5", "Bihar": None}}, "launch_year": 2019, "renewal_required": False, "renewal_process": "yearly",
        "faq": [{"question_en": "Q?", "answer_en": "A.", "question_hi": "प्र", "answer_hi": "उ"}, {"question_en": "only"}],
    }
    (d / "alpha.json").write_text(json.dumps(full, ensure_ascii=False, indent=1))
    (d / "beta.json").write_text(json.dumps({"id": "beta", "name_en": "Beta", "eligibility_rules": {"income_max_annual": "Rs 2.5 lakh", "age_max": 40}, "documents_en": []}))
    (d / "broken.json").write_text('{"id": "broken", "name_en": ')
    return str(d)


def test_scan_drops_broken_files(spark, folder):
    df = readers.scan_documents(spark, folder)
    assert {r["file_key"] for r in df.select("file_key").collect()} == {"alpha", "beta"}
    assert df.columns[:-1] == SCHEME.fieldNames()
    slim = readers.scan_for_eligibility(df)
    assert slim.where("id = 'alpha'").first()["documents"] == ["one", "two"]


def test_chunks(spark, folder):
    made = chunks.build_chunks(readers.scan_documents(spark, folder)).cache()
    alpha = {r["chunk_type"]: r["text"] for r in made.where("scheme_id = 'alpha'").collect()}
    assert list(r["chunk_type"] for r in made.where("scheme_id = 'alpha'").orderBy("pos").collect()) == ["overview", "benefit", "eligibility", "documents", "hindi_docs", "apply", "hindi", "state_wise", "metadata", "renewal", "keywords", "faq"]
    assert alpha["overview"] == "passage: [SCHEME:alpha] Alpha — Overview: D Benefit: B Ministry:  Keywords: k1, k2"
    assert "BPL required: True | Land ownership required: None | Age: 18-None | Income max: ₹{'EWS': 300000, 'LIG': '6 lakh'}" in alpha["eligibility"]
    assert alpha["state_wise"].endswith("(varies by state): Goa: Rs 5")
    assert alpha["renewal"].endswith("Required: False | yearly")
    assert alpha["faq"].endswith("Q: Q? A: A. | हिंदी: प्र: प्र उ: उ")
    assert {r["chunk_type"] for r in made.where("scheme_id = 'beta'").collect()} == {"overview", "benefit", "eligibility", "metadata"}
    twice = made.union(made.withColumn("file_key", F.concat("file_key", F.lit("z"))))
    ids = chunks.distinct_chunks(twice).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in ids] == list(range(made.count())) and ids[0]["chunk_type"] == "overview"


def corpus(spark):
    return spark.createDataFrame([(0, "wage wage rate"), (1, "wage card"), (2, "crop loan card card")], "chunk_id long, text string")


def test_bm25_golden(spark):
    q = spark.createDataFrame([(1, "wage card"), (2, "wage wage")], "query_id long, text string")
    want = {(1, 1): 1.105891, (1, 0): 0.671434, (1, 2): 0.606456, (2, 0): 1.342868, (2, 1): 1.105891}
    for scores in (retrieval.bm25_scores(corpus(spark), q), retrieval.index_scores(retrieval.build_index(corpus(spark)), q)):
        assert {(r["query_id"], r["chunk_id"]): r["score"] for r in scores.collect()} == want
    idf = {r["term"]: round(r["idf"], 6) for r in retrieval.build_index(corpus(spark)).terms.collect()}
    assert idf["wage"] == 0.470004 and idf["crop"] == 0.980829
    assert {r["term"]: r["chunks"] for r in retrieval.inverted_lists(retrieval.term_frequencies(corpus(spark))).collect()}["card"] == [1, 2]
    assert {(r["term"], r["block"]) for r in retrieval.inverted_lists(retrieval.term_frequencies(corpus(spark)), 2).collect()} >= {("card", 0), ("card", 1)}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, score double")


def test_fusion_golden(spark):
    dense, sparse = ranked(spark, [(1, 0, 10, 0.9), (1, 1, 11, 0.8)]), ranked(spark, [(1, 0, 12, 5.0), (1, 1, 10, 4.0)])
    types = spark.createDataFrame([(10, "faq", "a"), (11, "metadata", "a"), (12, "faq", "b")], "chunk_id long, chunk_type string, entity string")
    fused = retrieval.fuse(dense, sparse, types)
    got = {r["chunk_id"]: r["rrf"] for r in fused.collect()}
    assert got == pytest.approx({10: 0.021191168693812795, 11: 0.007862903225806453, 12: 0.007459016393442622}, abs=1e-15)
    parts = fused.repartition(7).orderBy("chunk_id").collect()
    assert [r["rrf"] for r in parts] == pytest.approx([got[i] for i in (10, 11, 12)], abs=1e-15)
    best = retrieval.best_per_entity(fused, "entity", 1).collect()
    assert [(r["entity"], r["chunk_id"], r["place"]) for r in best] == [("a", 10, 1)]
    alone = {r["chunk_id"]: r["rrf"] for r in retrieval.fuse(dense, sparse.where("false"), types).collect()}
    assert alone == pytest.approx({10: 1.3 * 0.9, 11: 0.75 * 0.8})
    assert retrieval.confidence(dense).first()["confidence"] == 0.9


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inverted_lists_need_one_shuffle(spark):
    lists = retrieval.inverted_lists(retrieval.chunk_terms(corpus(spark).union(corpus(spark))), 2)
    assert plan_of(lists).count("Exchange hashpartitioning") == 1
    want = retrieval.inverted_lists(retrieval.term_frequencies(corpus(spark)), 2)
    assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, want.collect()))


def test_bm25_deals_by_chunk(spark):
    """No term is a key of the scoring shuffle, and sums of a chunk are made where its postings lie."""
    q = spark.createDataFrame([(1, "card"), (2, "card of")], "query_id long, text string")
    plan = plan_of(retrieval.bm25_scores(corpus(spark), q))
    assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(query_id" not in plan and "hashpartitioning(term" not in plan.split("asked-weights")[0]


def test_dense_scores_take_bounded_memory():
    """A cell of 600 queries and 40,000 vectors with many ties, against one sort; scores in full would take 192 MB and more for their order."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    q, v = rng.integers(-2, 3, (600, 4)).astype(float), rng.integers(-2, 3, (40_000, 4)).astype(float)
    ids = rng.permutation(40_000)
    tracemalloc.start()
    got = retrieval._hits(pa.array(np.arange(600)), q, pa.array(ids), v, 20, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    for i in range(0, 600, 97):
        best = np.lexsort((ids, -(v @ q[i])))[:20]
        assert got[1].to_numpy()[20 * i : 20 * i + 20].tolist() == ids[best].tolist() and got[2].to_numpy()[20 * i : 20 * i + 20].tolist() == (v @ q[i])[best].tolist()


def test_dense_and_hydration(spark, folder):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "chunk_id long, vector array<float>")
    q = spark.createDataFrame([(5, [0.0, 1.0])], "query_id long, vector array<float>")
    top = retrieval.dense_top(v, q, 1).collect()
    assert [(r["chunk_id"], r["rank"], r["score"]) for r in top] == [(2, 0, 0.8)]
    odd = spark.createDataFrame([(3, None), (None, [0.0, 1.0]), (4, [1.0]), (0, [0.6, 0.8])], "chunk_id long, vector array<float>")
    more = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(30)] + [(99, None)], "query_id long, vector array<float>")
    got = retrieval.dense_top(v.union(odd).repartition(3), more, 2, query_block=8).collect()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in got) == [(i, n, c) for i in range(30) for n, c in ((0, 0), (1, 2))]
    import random

    rng = random.Random(1)
    many = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(rng.choice([3, 3, 5, 0]))]) for i in range(200)], "chunk_id long, vector array<float>")
    asks = many.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    one, cells = (sorted(map(tuple, retrieval.dense_top(many, asks, 7, query_block=b, vector_block=30).collect())) for b in (4096, 11))
    assert one == cells and len(one) > 300
    few = sorted(map(tuple, retrieval.dense_top(many, asks, 7, query_block=11, vector_block=1).collect()))
    assert few == one
    hits = spark.createDataFrame([(5, 1, "alpha", "faq"), (5, 2, "gone", "faq")], "query_id long, place int, scheme_id string, chunk_type string")
    full = retrieval.hydrate(hits, readers.scan_documents(spark, folder), F.lit("hi"))
    rows = full.collect()
    assert len(rows) == 1 and rows[0]["documents"] == ["एक"] and len(full.columns) == 2 + 15
    block = retrieval.prompt_blocks(full).first()["text"]
    assert block.startswith("── SCHEME: Alpha (अल्फा) ──\nBENEFIT: B\nSTATE-WISE AMOUNTS: Goa: Rs 5") and block.endswith("[matched via: faq]")


@pytest.mark.parametrize("n, want", [(19, None), (20, 20), (40, 39), (100, 96)])
def test_p95(spark, n, want):
    e = spark.range(1, n + 1).select(F.lit("s").alias("session_id"), F.lit("c").alias("call_type"), F.col("id").cast("double").alias("latency_ms"), F.lit(1).alias("cache_hit"), *(F.lit(1).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")))
    assert usage.token_summary(e).first()["p95_latency_ms"] == want
    assert [r["p95"] for r in usage.nearest_rank_p95(e, ["call_type"], "latency_ms").collect()] == ([want] if want else [])


def test_p95_of_groups_that_spread_over_partitions(spark):
    """One group with most rows, small ones, a null one and ties, against sorting."""
    rng = random.Random(4)
    rows = [("big", float(rng.randrange(900))) for _ in range(5000)] + [(f"s{i % 30}", float(rng.randrange(9))) for i in range(900)] + [(None, float(i)) for i in range(40)] + [("few", 1.0), ("few", None)]
    got = {r["g"]: r["p95"] for r in usage.nearest_rank_p95(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        if len(v) >= 20:
            want[g] = v[min(len(v) * 95 // 100, len(v) - 1)]
    assert got == want


def test_empty_usage(spark):
    e = spark.createDataFrame([], USAGE_EVENT)
    t = usage.guardrail_totals(e).first()
    assert (t["total"], t["blocked"], t["allowed"], t["block_rate_pct"]) == (0, 0, 0, 0.0)
    assert usage.grand_total(e).first()[0] == 0 and usage.cache_totals(e).first()["tokens_saved"] == 0


def test_presented(spark):
    df = spark.createDataFrame([(2.675, None), (1.005, 0.125)], "a double, b double")
    assert [r["a"] for r in usage.presented(df).collect()] == [2.67, 1.0] or [r["a"] for r in usage.presented(df).collect()] == [2.68, 1.01]


def test_quality_and_eligibility(spark, folder):
    schemes = readers.scan_documents(spark, folder)
    issues = {r["id"]: r["i"] for r in schemes.select("id", rules.quality_issues().alias("i")).collect()}
    assert issues["beta"][-4:] == ["faq missing", "faq < 5 items", "documents_hi missing", "apply_steps_hi missing"]
    assert "name_hi missing" not in issues["alpha"] and "faq missing" not in issues["alpha"]
    people = spark.createDataFrame(
        [(1, "farmer", "female", True, 500000, 30), (2, "student", "female", True, 100, 30), (3, None, None, None, None, None), (4, "farmer", "female", True, 700000, 30), (5, "student", "male", False, 250001, 41), (6, "farmer", "female", False, 1, 17)],
        "profile_id long, occupation string, gender string, is_bpl boolean, annual_income long, age int",
    ).withColumns({c: F.lit(None).cast("boolean") for c in ("has_land", "has_girl_child", "is_pregnant")})
    got = {(r["profile_id"], r["id"]) for r in rules.match(people, schemes).collect()}
    assert got == {(1, "alpha"), (3, "alpha"), (3, "beta"), (2, "beta"), (6, "beta")}
    bands = schemes.select("id", rules.income_limits(F.col("eligibility_rules.income_max_annual")).alias("b")).collect()
    assert {r["id"]: [tuple(x) for x in r["b"]] for r in bands} == {"alpha": [("EWS", 300000), ("LIG", 600000)], "beta": [("all", 250000)]}
    ids = spark.createDataFrame([("alpha",)], "id string")
    assert [(r["pos"], r["document"]) for r in rules.checklist(schemes, ids, "mr").collect()] == [(1, "one"), (2, "two")]
    assert rules.sms_text(schemes, ids).first()["sms"] == "Alpha: B\nDocs: one, two"
    assert rules.ineligible_text(spark.createDataFrame([("x", "X", "too old")], "id string, name_en string, reason string")).first()[0] == "- X: too old"
    assert rules.eligible_text(spark.createDataFrame([], "id string, name_en string, benefit_en string, reason string, documents array<string>, url string, helpline string")).first()[0] == "None"


def when(s):
    return dt.datetime.fromisoformat(s)


def test_cache_sinks(spark):
    cache = spark.createDataFrame([("k", "exact", "general_answer", "old", "en", when("2024-01-01T00:00:00"), when("2024-01-02T00:00:00"), 7)], CACHE)
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert sinks.unexpired(cache, now).count() == 1 and readers.live_response(cache, "k", now).count() == 1
    assert sinks.unexpired(cache, now + F.expr("interval 1 second")).count() == 0
    new = spark.createDataFrame([("k", "slot_question", "new", "hi"), ("b", "slot_question", "  ", "hi"), ("n", "else", "x", "hi")], "cache_key string, call_type string, response string, lang string")
    out = {r["cache_key"]: r for r in sinks.cache_put(cache, new, now).collect()}
    assert set(out) == {"k", "n"} and out["k"]["hit_count"] == 7 and out["k"]["response"] == "new" and out["n"]["hit_count"] == 0
    assert out["k"]["expires_at"] == when("2024-01-09T00:00:00") and out["n"]["expires_at"] == when("2024-01-02T01:00:00")
    assert sinks.without_keys(cache, new.select("cache_key"), "cache_key").count() == 0
    assert sinks.with_hits(cache, spark.createDataFrame([("k",), ("k",)], "cache_key string")).first()["hit_count"] == 9


def test_event_log_sink(spark, tmp_path):
    e = spark.createDataFrame([("s", "llm_call", "q" * 400)], "session_id string, event_type string, query_text string")
    rows = sinks.event_rows(e, USAGE_EVENT, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    assert rows.columns == USAGE_EVENT.fieldNames() and len(rows.first()["query_text"]) == 300
    for _ in range(2):
        sinks.append(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("day = '2024-01-02'").count() == 2
    assert sinks.grown(e, USAGE_EVENT).columns[:3] == e.columns and sinks.grown(sinks.grown(e, USAGE_EVENT), USAGE_EVENT).count() == 1
    assert sinks.audit(spark.createDataFrame([(" ",), (None,), ("x",)], "t string"), "t").collect() == [("EMPTY",), ("EMPTY",), ("x",)]


def test_json_files(spark, folder, tmp_path):
    df = readers.scan_documents(spark, folder).select("id", "name_hi", "documents_en")
    sinks.as_json_files(df, str(tmp_path / "j"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "j"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_sessions_round_trip(spark):
    rows = spark.createDataFrame([("s", None, None, None, None, None, None, None, None, 1)], "id string, language string, language_source string, turn int, confirmed_facts string, pending_slots string, conversation_buffer string, entity_memory string, eligibility_done int, in_eligibility_flow int")
    got = readers.decoded_sessions(rows).first()
    assert (got["language"], got["language_source"], got["turn"], got["conversation_buffer"], got["eligibility_done"], got["in_eligibility_flow"]) == ("hi", "default", 0, [], False, True) and len(got["pending_slots"]) == 9
    again = readers.decoded_sessions(sinks.encoded_sessions(readers.decoded_sessions(rows))).first()
    assert again == got


def test_index_round_trip(spark, tmp_path):
    i = retrieval.build_index(corpus(spark))
    sinks.write_index({"postings": i.postings, "terms": i.terms, "lengths": i.lengths, "stats": i.stats}, str(tmp_path / "ix"))
    back = retrieval.read_index(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "wage card")], "query_id long, text string")
    assert retrieval.index_scores(back, q).count() == 3


def test_union_if_empty_and_snippets(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert readers.union_if_empty(a, b).collect() == [(1,)] and readers.union_if_empty(a.where("false"), b).collect() == [(2,)]
    hits = spark.createDataFrame([(1, 1, "T", "c" * 900), (1, 2, "U", " "), (1, 5, "V", "x")], "query_id int, rank int, title string, content string")
    assert readers.search_snippets(hits).first()["text"] == "[T] " + "c" * 800


def test_recent_entities_reenter_after_being_pushed_out(spark):
    m = [("k", e, i) for i, e in enumerate("abcdefa")] + [("r", e, i) for i, e in enumerate("aba")]
    got = {r["key"]: r["recent"] for r in state.recent_entities(spark.createDataFrame(m, "key string, e string, o int"), "key", "e", "o").collect()}
    assert got == {"k": list("afedc"), "r": list("ba")}


def test_replay_ttl_window_is_anchored_at_the_miss(spark):
    r = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 10, 11, 21, 22])], "key string, at long, id long")
    got = state.replay_ttl(r, "key", "at", F.lit(10), "id").orderBy("at").collect()
    assert [x["hit"] for x in got] == [0, 1, 0, 1, 0]


def test_merges(spark):
    a, b = spark.createDataFrame([(1, "x", None), (2, "y", [1, 2])], "id int, s string, l array<int>"), spark.createDataFrame([(1, None, [3]), (2, "z", [4]), (3, "n", None)], "id int, s string, l array<int>")
    got = {r["id"]: (r["s"], r["l"]) for r in state.overlay(a, b, "id").collect()}
    assert got == {1: ("x", [3]), 2: ("z", [4]), 3: ("n", None)}
    assert {r["id"]: r["l"] for r in state.longer_wins(a, b, "id", "l").collect()} == {1: [3], 2: [1, 2]}
    assert state.pending(b, a.select("id"), "id").select("id").collect() == [(3,)]
