"""Conversation repair against a search over all edit sequences and a plain replay of the damage."""

import hashlib
import heapq
import random
import re
import zlib

from heddle.llm import repair

SF = "/root/testdata/sf0.001"
SEEN = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = SEEN.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows, found):
    """Dijkstra over (cost, audit so far): the first complete sequence taken out is the cheapest and, of those, the least."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, kept = heapq.heappop(heap)
        letters = "".join(r[0][:1] or "?" for r in kept)
        if not re.fullmatch(r"s?(ua)*u?", letters):
            continue
        if i == len(rows) and GRAMMAR.fullmatch(letters):
            return cost, audit, kept
        state = (i, "" if not letters else letters[-1])
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*kept, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, kept))
            if found[i] not in ("blank", "duplicate"):
                more, text = int(found[i] == "truncated"), rows[i][3]
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*kept, (rows[i][2], text))))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, (*kept, (role, text))))


def expected(rows):
    whole = {}
    for r in rows:
        whole.setdefault(r[0], []).append(r)
    out = set()
    for conv, own in whole.items():
        own = damage(own)
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, kept = search(own, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.add((conv, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return out


def made(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "usher"]
    texts = ["Yes.", "No!", "And then", "", " \t", None, "Why? \n", "x" * 3000 + ".", "été", "Yes."]
    rows = []
    for conv in range(n):
        turn = rng.choice([0, 0, 5])
        for _ in range(rng.randrange(1, 12)):
            rows.append((None if conv == 3 else conv, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 1, 2, 0])
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def test_repair_matches_search(spark):
    rows = made(random.Random(5), 300)
    df = spark.createDataFrame(rows + [(9000 + i, 0, "user", "Hi.") for i in range(60)], COLUMNS).selectExpr("*", "1 AS key", "2 AS gone", "3 AS cost", "4 AS audit", "'x' AS signs")
    got = [tuple(r) for r in repair.repair(repair.damaged(df)).collect()]
    want = expected([tuple(r)[:4] for r in df.collect()])
    assert len(got) == len(want) and set(got) == want
    assert any(r[7] == "" and r[6] == 0 for r in got)  # all rows of a conversation dropped


def test_repair_on_given_tables(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {tuple(r) for r in repair.repair(repair.damaged(df)).collect()}
    assert got == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repair_empty_and_one_long_conversation(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], COLUMNS))).count() == 0
    rng = random.Random(8)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"row {i}" + rng.choice([".", ""])) for i in range(5000)]
    got = repair.repair(repair.damaged(spark.createDataFrame(rows, COLUMNS))).collect()
    own = damage(rows)
    assert len(got) == 1 and got[0]["truncated"] == faults(own).count("truncated") and len(got[0]["audit"].replace("I", "")) == len(own)


def test_nodes_are_shared_by_equal_ends():
    path = [repair.END]
    word = "".join(random.Random(1).choice("ABCDEFGHIJKL") for _ in range(40))
    for sign in reversed(word):
        path.append(repair.node(sign, path[-1]))
    for cut in range(41):
        alone = [repair.END]
        for sign in reversed(word[cut:]):
            alone.append(repair.node(sign, alone[-1]))
        assert alone[-1] == path[40 - cut] and repair.audit(word[cut:], alone) == repair.audit(word[cut:], path[: 41 - cut])
