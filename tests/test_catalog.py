"""Every catalogue query against its SQL; rows only where SQL cannot say it."""

import re

import pytest

from heddle.plans import catalog, oracles


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(name, same):
    same(name, catalog.QUERIES[name], oracles.SQL[name])


def test_every_query_is_compared_or_tested():
    assert set(catalog.QUERIES) - set(oracles.SQL) == {"session_machine"}
    assert set(oracles.SQL) <= set(catalog.QUERIES)


def test_json_repair_reads_every_damage(spark):
    rows = catalog.QUERIES["json_repair"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["found"] == r["conv_id"] and r["second"] == 2 for r in rows)
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn").collect()
    assert sorted((r["conv_id"], r["turn"]) for r in rows) == sorted(map(tuple, given))


def test_session_machine_replay(spark):
    """The whole query against the plain machine of the stream tests."""
    from test_streaming import plain_machine

    from heddle.streaming import sessions

    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("role = 'user'").collect()
    said = {0: "__init__", 2: "👩 woman hoh", 4: "yes"}
    words = {(r["conv_id"], r["turn"]): re.search("[a-z]{9,}", r["text"].lower()) for r in c}
    df = spark.createDataFrame([(r["conv_id"], r["turn"], said.get(r["turn"], r["text"]), (m := words[r["conv_id"], r["turn"]]) and m[0]) for r in c], "conv_id long, turn long, text string, entity string")
    got = catalog.QUERIES["session_machine"](spark, "/root/testdata/sf0.001").collect()
    want = [r[1:-1] for r in plain_machine(sessions.prepared(df).collect()) if r[0] == "turn"]
    assert sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in got), key=repr) == sorted(want, key=repr)


def test_slot_dialogue_replay(spark):
    """The whole query against a dialogue played by hand, message by message."""
    from heddle.functions.fixed import BINARY_SLOTS, NO_WORDS, OCCUPATION_BUTTONS, YES_WORDS

    slots = ["occupation", "gender", "has_land", "is_bpl", "has_girl_child", "is_pregnant", "annual_income", "state", "age"]
    buttons = {k.lower(): v for k, v in OCCUPATION_BUTTONS.items()}
    said = {0: "👩 woman hoh", 2: "yes", 4: "nahi"}

    def due(facts):
        if "gender" not in facts and facts.get("occupation") == "woman_hoh":
            facts["gender"] = "female"
        return next((s for s in slots if s not in facts), None)

    want, facts = [], {}
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("role = 'user'").collect()
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        own = facts.setdefault(r["conv_id"], {})
        text, asked = said.get(r["turn"], r["text"]).strip(), due(own)
        before = dict(own)
        if text.lower() in buttons:
            own["occupation"] = buttons[text.lower()]
            filled = True
        elif asked in BINARY_SLOTS:
            filled = text.lower() in YES_WORDS | NO_WORDS
            if filled:
                own[asked] = str(text.lower() in YES_WORDS).lower()
        else:
            filled = asked is not None and text != ""
            if filled:
                own[asked] = text
        assert filled or own == before
        want.append((r["conv_id"], r["turn"], asked, filled, due(own)))
    got = [tuple(r) for r in catalog.QUERIES["slot_dialogue"](spark, "/root/testdata/sf0.001").select("conv_id", "turn", "asked", "filled", "next_slot").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
