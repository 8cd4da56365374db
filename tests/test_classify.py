"""Classification and slot extraction around a model that replies, fails, or talks nonsense."""

from pyspark.sql import functions as F

from heddle.plans import classify


def test_classify_with_models_and_without(spark):
    rows = [(1, "which papers do I need", "", False), (2, "मुझे योजना के बारे में बताओ", "en", False), (3, "haan", "ta", True), (4, None, None, False), (5, "boom", None, False)]
    df = spark.createDataFrame(rows, "id int, text string, known string, in_flow boolean")

    def model():
        def reply(texts):
            if any("boom" in t for t in texts):
                raise OSError("down")
            return ['{"intent": "scheme_query", "language": "English", "new_facts": {"age": 7, "state": null, "has_land": false}, "resolved_query": "R"}' if "papers" in t else "```json\n{'intent': 'dance', new_facts: [1],}\n```" for t in texts]

        return reply

    out = classify.classify(df, F.concat(F.lit("say: "), F.coalesce("text", F.lit(""))), [model], F.col("known"), F.col("in_flow"), retries=0, wait=0.0, most=1)
    got = {r["id"]: r for r in out.collect()}
    assert out.columns == ["id", "text", "known", "in_flow", "language", "language_source", "intent", "new_facts", "scheme_mentioned", "resolved_query", "model_error"]
    assert (got[1]["language"], got[1]["language_source"], got[1]["intent"], got[1]["new_facts"], got[1]["resolved_query"]) == ("en", "auto_detected", "scheme_query", {"age": "7", "has_land": "false"}, "R")
    assert (got[2]["language"], got[2]["language_source"], got[2]["resolved_query"]) == ("mr", "script_detected", rows[1][1])
    assert (got[3]["language"], got[3]["language_source"], got[3]["intent"], got[3]["new_facts"]) == ("ta", "session", "slot_fill_response", {})
    assert got[4]["intent"] == "scheme_query" and got[4]["language"] == "hi"
    assert got[5]["model_error"] == "OSError: down" and got[5]["intent"] == "scheme_query" and got[5]["resolved_query"] == "boom"


def test_slot_values(spark):
    cases = [('{"age": 30}', "age", "30"), ('{"age": "30"}', "age", "30"), ('{"has_land": "Yes"}', "has_land", "true"), ('{"has_land": "0"}', "has_land", "false"), ('{"has_land": 1}', "has_land", "1"), ('{"has_land": false}', "has_land", "false"), ('{"age": null}', "age", None), ("{}", "age", None), ("what?", "age", None), (None, "age", None), ('{"age": 2.5, }', "age", "2.5"), ('{"state": "Goa"}', "state", "Goa")]
    df = spark.createDataFrame([(i, r, s) for i, (r, s, _) in enumerate(cases)], "i int, raw string, slot string")
    got = {r["i"]: r["v"] for r in df.select("i", classify.slot_value(F.col("raw"), F.col("slot")).alias("v")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}
    one = classify.extract_slot(df.limit(1), F.col("raw"), [lambda: lambda xs: ['{"age": "no"}' for _ in xs]], F.lit("age"))
    assert one.first()["value"] == "false"
