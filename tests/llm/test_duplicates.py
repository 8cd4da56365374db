"""Line, set, passage and fuzzy duplicates against brute force on small fixtures with every awkward row."""

import collections
import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.llm import chaining, common, jaccard, line_dedup, seeds, suffix_array, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(FOLD))


def corpus():
    """Families of copies and near copies, shared passages, a hot passage, blanks, nulls, repeated rows and ids."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    hot, passage = make(60), make(70)
    rows = []
    for f in range(12):
        base = make(rng.randrange(20, 160))
        for _ in range(rng.randrange(1, 9)):
            w = base.copy()
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 12, len(base) // 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    rows += [" ".join(make(30) + hot + make(rng.randrange(5, 90))) for _ in range(40)]
    rows += [" ".join(make(20) + passage + make(20)), " ".join(passage + make(9)), " ".join(make(80) + passage)]
    rows += [" ".join(hot)] * 3 + ["a b", "A  b", "c", "", None, " \n\t ", "a a a a a a a a a a", "a a a a a", " ".join(make(9000))]
    order = list(range(len(rows)))
    rng.shuffle(order)
    out = [(i, rows[j]) for i, j in enumerate(order)]
    return [*out, out[3], out[3], (out[5][0], out[9][1]), (None, rows[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    clash = ["key", "rep", "n", "h1", "pos", "doc", "grp", "m", "x", "words", "component_id"]
    return df.select("*", *(F.lit(c).alias(c) for c in clash)).repartition(5)


# --- common --------------------------------------------------------------------------------------


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=18))
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = common.connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_a_path_and_a_star(spark):
    path = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1400).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = common.connected_components(path.union(star)).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {0: 401, 1000: 400}


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["The the\x0bTHE", None, "", "  é É ", "a" * 700_000 + " b"]
    w = words.Words(pa.array(texts))
    got = [w.h[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
    assert [len(x) for x in got] == [3, 0, 0, 2, 2]
    assert len(set(got[0])) == 1 and got[3][0] != got[3][1]
    sliced = words.Words(pa.array(texts).slice(3, 2))
    assert sliced.h.tolist() == got[3] + got[4]


# --- lines ---------------------------------------------------------------------------------------


def lines_expected(rows):
    keys = collections.defaultdict(set)
    strip = "\t\n\x0b\x0c\r "
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                keys[line.strip(strip).translate(FOLD)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(k := x.strip(strip).translate(FOLD)) < 10 or len(keys[k]) < 2 or d == min(keys[k])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINES = [
    (3, "Shared line here\nown\n\nshared LINE here  \n"), (1, "x\n\tshared line HERE\x0b\nshared line here"), (2, None), (4, ""), (5, "ééééééééé1\nshort"), (6, "ÉÉÉÉÉÉÉÉÉ1\nééééééééé1"), (7, "\n".join(f"line number {i % 130}" for i in range(300))),
    (8, "\n".join(f"line number {i}" for i in range(100))), (8, "\n".join(f"line number {i}" for i in range(100))), (8, "other text of the same id\nshared line here"), (None, "shared line here\nshared line here"), (None, None), (9, "shared line here"),
]


def test_lines(spark):
    df = spark.createDataFrame(LINES, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("doc", "rk", "k1", "keep", "pos", "line", "word", "hot", "salt", "first_doc")))
    done = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
    got = [(r["doc_id"], r["n"], r["d"], r["s"]) for r in done.select("doc_id", F.size("__hd_lines").alias("n"), F.col("__hd_dropped").alias("d"), F.sha2(F.array_join("__hd_kept", "\n"), 256).alias("s")).collect()]
    assert sorted(got, key=str) == lines_expected(LINES)
    df = df.withColumn("__hd_doc", F.lit(2)).withColumn("a.b", F.lit(3))
    back = line_dedup.dedup_lines(df)
    assert back.columns == df.columns and back.count() == len(LINES)
    assert back.where("doc_id = 2").first()["text"] is None and back.where("doc_id = 9").first()["text"] == ""
    bitmaps = line_dedup.keep_bitmaps(df).where("doc = 8 and n_dropped > 50").first()
    assert bitmaps["n_dropped"] == 100 and len(bitmaps["keep"]) == 2
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_lines_of_the_corpus(spark, docs):
    rows = [(d, None if t is None else t.replace(" w1", "\nw1")) for d, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (line_dedup.HOT, 3):
        done = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, hot=hot))
        got = [(r["doc_id"], r["n"], r["d"], r["s"]) for r in done.select("doc_id", F.size("__hd_lines").alias("n"), F.col("__hd_dropped").alias("d"), F.sha2(F.array_join("__hd_kept", "\n"), 256).alias("s")).collect()]
        assert sorted(got, key=str) == lines_expected(rows)


# --- sets ----------------------------------------------------------------------------------------


def shingles(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def test_jaccard(docs):
    rows = corpus()
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    want = sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)
    for how in ({}, {"order_most": 0, "large_cell": 2, "block": 9}):
        got = jaccard.jaccard_classes(docs, **how)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == want
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {find(d) for d in parent} | {None}
    assert jaccard.jaccard_classes(docs.where("false")).count() == 0


def test_jaccard_of_words_that_polynomial_hashes_confuse(spark):
    words = ["a"]
    for _ in range(13):
        words.append(words[-1] + words[-1].translate(str.maketrans("ab", "ba")))
    rows = [w for x in words[10:] for w in (x, x.translate(str.maketrans("ab", "ba")))]
    got = jaccard.jaccard_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["component_id"] == r["doc_id"] for r in got)


def test_shingle_sets_are_made_in_small_pieces(monkeypatch):
    text = [" ".join(f"w{(i * 7919 + j * j) % 50021}" for j in range(400)) for i in range(1500)] + ["", None, "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(text)], ["text"])
    tracemalloc.start()
    got = jaccard._sets(batch, 0, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * batch.nbytes  # all words at once take about 19 bytes a byte of text
    monkeypatch.setattr(jaccard, "PIECE", 1 << 30)
    whole = jaccard._sets(batch, 0, 5)
    assert len(got) == len(whole) == len(text) and all((x == y).all() for x, y in zip(got, whole))


def test_shingle_counts_cover_all_documents(spark, docs):
    """Every shingle that ``LEAST`` or more rows hold gets a level, by whatever partitions; no other does."""
    want = collections.Counter(s for _, t in corpus() for s in shingles(t))
    got = [r["level"] for r in jaccard.common_shingles(docs, 5).collect()]
    assert sorted(got) == sorted(n.bit_length() - 1 for n in want.values() if n >= jaccard.LEAST)


# --- passages ------------------------------------------------------------------------------------


def repeats(rows, least):
    """Word positions of each document that some window of ``least`` words shared with another document covers."""
    own = collections.defaultdict(set)
    texts = {}
    for d, t in rows:
        if d is not None and t is not None and d not in texts:
            texts[d] = split(t)
    for d, w in texts.items():
        for i in range(len(w) - least + 1):
            own[tuple(w[i : i + least])].add(d)
    out = {}
    for d, w in texts.items():
        hit = {j for i in range(len(w) - least + 1) if len(own[tuple(w[i : i + least])]) > 1 for j in range(i, i + least)}
        if hit:
            out[d] = hit
    return texts, out


@pytest.fixture(scope="module")
def once(docs):
    """The corpus with each id once: what is compared word by word."""
    seen, rows = set(), []
    for d, t in corpus():
        if d is None or d not in seen:
            seen.add(d)
            rows.append((d, t))
    return rows, docs.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("clash"))


def test_suffix_array(once):
    rows, df = once
    texts, want = repeats(rows, 50)
    found = suffix_array.repeated_passages(df).collect()
    got = collections.defaultdict(set)
    for r in found:
        s, t, n = r["start_word"], r["other_start_word"], r["n_words"]
        assert n >= 50 and r["doc_id"] != r["other_doc_id"] and texts[r["doc_id"]][s : s + n] == texts[r["other_doc_id"]][t : t + n]
        assert r["is_copy"] == (r["other_doc_id"] < r["doc_id"])
        got[r["doc_id"]] |= set(range(s, s + n))
        got[r["other_doc_id"]] |= set(range(t, t + n))
    assert set(got) == set(want)
    assert sum(len(got[d] & want[d]) for d in want) >= 0.97 * sum(map(len, want.values())) and all(got[d] <= want[d] for d in want)
    cut = suffix_array.cut_copies(df, suffix_array.repeated_passages(df))
    assert cut.columns == df.columns and cut.count() == df.count()


def test_suffix_array_covers_all_in_families_of_edited_copies(spark, once):
    """Every word that brute force marks: where the copy between two has an edit, where seeds return in snippets, and in the corpus."""
    rng = random.Random(5)
    make = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    p, runs = make(50), make(60)
    rows = [(1, make(9) + p + make(9)), (2, make(5) + p[:45] + make(1) + p[46:] + make(20)), (3, make(30) + p + make(3)), (4, make(20) + p[10:] + make(11) + p[:38] + make(9))]
    rows += [(10 + i, make(8) + runs[:at] + make(1) + runs[at + 1 :] + make(8)) for i, at in enumerate([0, 9, 3, 59, 52, 5, 55, 1])]
    rows += [(20, make(7) + runs + make(9) + runs[20:50] + make(9)), (30, ["a"] * 130), (31, ["a"] * 170 + ["b"])]
    small = [(i, " ".join(w)) for i, w in rows]
    for have, df in ((small, spark.createDataFrame(small, "doc_id long, text string")), once):
        texts, want = repeats(have, 50)
        got = collections.defaultdict(set)
        for r in suffix_array.repeated_passages(df).collect():
            a, b = texts[r["doc_id"]][r["start_word"] :][: r["n_words"]], texts[r["other_doc_id"]][r["other_start_word"] :][: r["n_words"]]
            assert a == b and len(a) >= 50
            got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
            got[r["other_doc_id"]] |= set(range(r["other_start_word"], r["other_start_word"] + r["n_words"]))
        assert all(w <= got[d] for d, w in want.items())


def test_suffix_array_reports_whole_matches(spark):
    """Matches of any length, also where another document holds the middle: every row is a maximal match of its two texts."""
    rng = random.Random(6)
    make = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    p, q = make(500), make(2000)
    rows = [(1, make(7) + p + make(9)), (2, make(3) + p[150:350] + make(4)), (3, make(11) + p + make(2)), (4, q + make(5)), (5, make(60) + q[100:1900] + make(1)), (6, q[900:1000] + make(8)), (7, make(9) + q)]
    rows += [(10, ["a"] * 900 + ["b"]), (11, ["c"] + ["a"] * 700), (12, ["x", "y", "z"] * 200), (13, make(3) + ["x", "y", "z"] * 150)]
    texts = dict(rows)
    found = suffix_array.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    for r in found:
        a, b, s, t, n = texts[r["doc_id"]], texts[r["other_doc_id"]], r["start_word"], r["other_start_word"], r["n_words"]
        assert a[s : s + n] == b[t : t + n] and n >= 50
        assert s == 0 or t == 0 or a[s - 1] != b[t - 1]
        assert s + n == len(a) or t + n == len(b) or a[s + n] != b[t + n]
    whole = {(r["doc_id"], r["other_doc_id"]): r["n_words"] for r in found if r["doc_id"] < 10}
    assert whole[3, 1] == 500 and {n for (x, y), n in whole.items() if 2 in (x, y)} == {200} and whole[5, 4] == 1800
    assert max(n for (x, y), n in whole.items() if {x, y} == {4, 7} or {x, y} == {5, 7}) >= 1800


def test_suffix_array_edges(spark, docs):
    assert suffix_array.repeated_passages(docs.where("false")).count() == 0
    assert suffix_array.repeated_passages(docs).count() > 0  # null and repeated ids
    one = spark.createDataFrame([(1, " ".join(["z"] * 500 + ["y"] * 500) + " " + " ".join(["z"] * 500 + ["y"] * 500))], "doc_id long, text string")
    assert suffix_array.repeated_passages(one).count() == 0
    with pytest.raises(ValueError):
        suffix_array.repeated_passages(one, k=10)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=80), st.integers(1, 12))
def test_minimisers_hit_every_window(values, w):
    h = np.array(values, np.uint64)
    at = set(seeds.minimisers(h, w).tolist())
    for i in range(len(h) - min(w, len(h)) + 1):
        window = h[i : i + w]
        low = [i + int(j) for j in np.flatnonzero(window == window.min())]
        # The smallest value of the window is kept, or a close repeat of it just before.
        assert any(j in at or any(h[q] == h[j] and j - w * len(h) <= q < j for q in at) for j in low)


def test_neighbour_stream_in_any_batches():
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted({(rng.randrange(6), rng.randrange(5), rng.randrange(9)) for _ in range(90)})
    runs = collections.defaultdict(lambda: collections.defaultdict(list))
    for h, d, p in rows:
        runs[h][d].append(p)
    want = set()
    for h, by in runs.items():
        ds = sorted(by)
        for i, d in enumerate(ds):
            other = ds[i - 1] if i else ds[1] if len(ds) > 1 else None
            if other is not None:
                want |= {(h, d, p, other, by[other][-1] if i else by[other][0]) for p in by[d]}
    for size in (1, 2, 3, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int32())], ["h", "doc", "pos"]) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        out = [r for b in seeds._compare(iter(batches)) for r in b.to_pylist()]
        got = [(r["h"], r["doc"], r["pos"], r["odoc"], r["opos"]) for r in out if not r["edge"]]
        assert len(got) == len(set(got)) and set(got) == want
        edges = {(r["h"], r["doc"]) for r in out if r["edge"]}
        assert edges == {rows[0][:2], rows[-1][:2]}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 6)), min_size=1, max_size=14, unique=True))
def test_chain_scores_are_best(parts):
    """The best chain by the Fenwick tree against the quadratic recurrence."""
    parts = sorted(parts)
    gap = 0.1

    def ok(p, q):
        return p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1]

    best = []
    for q in parts:
        best.append(q[2] + max([0.0, *(s - gap * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2]) for p, s in zip(parts, best) if ok(p, q))]))
    top = chaining.chains(parts, gap)[0]
    score = sum(p[2] for p in top) - gap * sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(top, top[1:]))
    assert all(ok(p, q) for p, q in zip(top, top[1:])) and score == pytest.approx(max(best))


def test_chaining(once):
    rows, df = once
    texts, want = repeats(rows, 50)
    found = chaining.fuzzy_passages(df).collect()
    got = collections.defaultdict(set)
    for r in found:
        a, b = texts[r["doc_id"]][r["start_word"] :][: r["n_words"]], texts[r["other_doc_id"]][r["other_start_word"] :][: r["other_n_words"]]
        assert min(len(a), len(b)) >= 50 and r["identity"] >= 0.75 and r["other_doc_id"] < r["doc_id"]
        assert r["matched_words"] <= sum((collections.Counter(a) & collections.Counter(b)).values())
        got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
        got[r["other_doc_id"]] |= set(range(r["other_start_word"], r["other_start_word"] + r["other_n_words"]))
    assert set(want) <= set(got)
    assert sum(len(got[d] & want[d]) for d in want) >= 0.97 * sum(map(len, want.values()))


def test_chaining_finds_edited_passages(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, rows = make(120), []
    for i in range(10):
        w = base.copy()
        for j in range(rng.randrange(6), 120, 15):
            w[j] = rng.choice(vocab)
        del w[rng.randrange(40, 60)]
        rows.append((i, " ".join(make(40) + w + make(40))))
    rows += [(100 + i, " ".join(make(200))) for i in range(30)]
    got = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} | {r["other_doc_id"] for r in got} == set(range(10))
    assert max(r["n_words"] for r in got) < 150 and max(r["identity"] for r in got) < 1


def covered(got, doc, length):
    words = np.zeros(length, bool)
    for r in got:
        for d, at, n in ((r["doc_id"], r["start_word"], r["n_words"]), (r["other_doc_id"], r["other_start_word"], r["other_n_words"])):
            words[at : at + n] |= d == doc
    return words


def test_chaining_splits_chains_at_wide_gaps(spark):
    """A copy with 60 words put into its middle, and two passages with other words between, in two documents each."""
    rng = random.Random(3)
    make = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    p, q, r = make(120), make(60), make(60)
    rows = [(1, make(30) + p + make(30)), (2, make(20) + p[:60] + make(60) + p[60:] + make(20)), (3, make(30) + q + make(110) + r + make(30)), (4, make(20) + q + make(100) + r + make(20))]
    got = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    for doc, length, spans in ((1, 180, [(30, 150)]), (2, 220, [(20, 80), (140, 200)]), (3, 290, [(30, 90), (200, 260)]), (4, 260, [(20, 80), (180, 240)])):
        words = covered(got, doc, length)
        assert all(words[a:b].all() for a, b in spans)
    assert len(got) == 4 and all(min(x["n_words"], x["other_n_words"]) >= 50 and x["identity"] >= 0.75 for x in got)


def test_chaining_links_all_holders_of_a_seed(spark):
    """Two copies of a passage whose only kept seeds many documents between them hold too, and the later copy again in a short snippet."""
    rng = random.Random(4)
    make = lambda n: [f"s{rng.randrange(10**6)}" for _ in range(n)]
    phrase, before, after = make(17), make(24), make(25)
    # Every fourth word outside the phrase is changed in the second copy: no other run of 8 words is left, identity about 0.8.
    edit = lambda w: [x if i % 4 else f"e{i}" for i, x in enumerate(w)]
    rows = [(1, make(20) + before + phrase + after + make(20) + phrase + make(30)), (50, make(10) + edit(before) + phrase + edit(after) + make(40))]
    rows += [(i, make(25) + phrase + make(25)) for i in range(2, 50)]
    got = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(50, 1)}


def family(rng, members, rate):
    """Copies of one text, each with its own edits and its own surroundings."""
    make = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    base = make(150)
    return [make(rng.randrange(5, 40)) + [x if rng.random() > rate else make(1)[0] for x in base] + make(rng.randrange(5, 40)) for _ in range(members)]


def test_chaining_of_a_large_family(spark):
    """Every member is linked or of one class; the rows stay far from all pairs; a passage of one member's own is found, too."""
    rng = random.Random(12)
    texts = family(rng, 120, 0.03)
    own = [f"o{i}" for i in range(70)]
    texts[17] = texts[17] + own
    texts.append([f"z{i}" for i in range(30)] + own + [f"y{i}" for i in range(30)])
    got = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()
    assert (120, 17) in {(r["doc_id"], r["other_doc_id"]) for r in got}
    near = {i: {i} for i in range(121)}
    for r in got:
        near[r["doc_id"]] = near[r["doc_id"]] | near[r["other_doc_id"]]
        for i in near[r["doc_id"]]:
            near[i] = near[r["doc_id"]]
    assert near[0] >= set(range(121)) and len(got) < 120 * 25


def brute_identity(x, y):
    return chaining._edit(np.array(x), np.array(y)) / max(len(x), len(y))


def test_chaining_recall_on_edited_passages(spark):
    """Pairs of texts with one passage edited at random: found by the operator, of those that an exact alignment accepts."""
    rng = random.Random(21)
    make = lambda n: [rng.randrange(10**6) for _ in range(n)]
    floor = {0.9: 0.97, 0.8: 0.75}
    for rate, least_found in ((0.1, floor[0.9]), (0.2, floor[0.8])):
        rows, true = [], set()
        for i in range(60):
            p = make(60)
            q = []
            for x in p:
                u = rng.random()  # a word stays, is changed (two thirds of the edits), goes, or gets a new one after it
                q += [x] if u > rate else make(1) if u > rate / 3 else [] if u > rate / 6 else [x, *make(1)]
            rows += [(2 * i, make(40) + p + make(40)), (2 * i + 1, make(40) + q + make(40))]
            if brute_identity(p, q) >= 0.75 and len(q) >= 50:
                true.add((2 * i + 1, 2 * i))
        df = spark.createDataFrame([(i, " ".join(map(str, w))) for i, w in rows], "doc_id long, text string")
        found = {(r["doc_id"], r["other_doc_id"]) for r in chaining.fuzzy_passages(df).collect()}
        assert found <= {(2 * i + 1, 2 * i) for i in range(60)}
        print("recall", rate, len(found & true), len(true))
        assert len(found & true) >= least_found * len(true)


def priorities(spark, n):
    """Ids 0 ... n - 1, first those that are pivots: the first under either global priority."""
    p = spark.range(n).selectExpr("id", "xxhash64(0, id) as p", "xxhash64(1, id) as q").collect()
    first = [min(p, key=lambda r: r[c])["id"] for c in ("p", "q")]
    return first, [i for i in range(n) if i not in first]


def test_chaining_compares_hot_seeds_without_a_rare_run(spark):
    """Two texts of one passage: a phrase that 40 others hold in other surroundings, beside it runs of two words at most."""
    rng = random.Random(31)
    make = lambda n: [f"h{rng.randrange(10**6)}" for _ in range(n)]
    phrase, more = make(22), make(40)
    _, ids = priorities(spark, 44)
    rows = [(i, make(40) + phrase + make(40)) for i in range(44) if i not in (ids[3], ids[20])]
    rows += [(i, make(40) + phrase + [w if j % 3 else make(1)[0] for j, w in enumerate(more)] + make(40)) for i in (ids[3], ids[20])]
    got = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(ids[20], ids[3])}


def test_chaining_compares_what_different_pivots_stand_for(spark):
    """A is like the one pivot and C, C like A alone; D is like the other pivot and A."""
    rng = random.Random(32)
    make = lambda n: [f"g{rng.randrange(10**6)}" for _ in range(n)]
    (p, q), ids = priorities(spark, 40)
    a, c, d = ids[1], ids[5], ids[9]
    phrase, left, right = make(16), make(40), make(36)
    edited = lambda: [w if j % 3 else make(1)[0] for j, w in enumerate(right)]
    rows = {i: make(60) + phrase + make(60) for i in range(40)}
    rows[p] = make(20) + left + phrase + make(60)
    rows[a] = make(20) + left + phrase + right + make(20)
    rows[c] = make(60) + phrase + edited() + make(20)
    rows[q] = make(60) + phrase + make(60)
    got = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    pair = lambda x, y: (max(x, y), min(x, y))
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {pair(p, a), pair(a, c)}
    # D is held by the other pivot (common words left of the phrase), and shares with A what is right of it.
    far = make(40)
    rows[q], rows[d] = make(20) + far + phrase + make(60), make(20) + far + phrase + edited() + make(20)
    got = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} >= {pair(p, a), pair(a, c), pair(a, d), pair(c, d), pair(q, d)}


def test_chaining_of_a_family_that_no_pivot_of_its_seed_belongs_to(spark):
    """One word 60 times over in 30 texts, whose only common seed has its pivots in short runs: rows grow with the family, not with its square."""
    rng = random.Random(41)
    make = lambda n: [f"k{rng.randrange(10**6)}" for _ in range(n)]
    first, ids = priorities(spark, 32)
    rows = [(i, make(30) + ["z"] * (10 if i in first else 60) + make(30)) for i in range(32)]
    got = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {i for r in got for i in (r["doc_id"], r["other_doc_id"])} == set(ids) and len(got) < 4 * len(ids)


def test_chaining_does_not_compare_the_places_of_two_periodic_texts_one_by_one(spark, monkeypatch):
    agreeing, plain = [], chaining.context_links
    monkeypatch.setattr(chaining, "context_links", lambda *a: agreeing.append(plain(*a)) or agreeing[0])
    period = [f"p{i}" for i in range(9)]
    rows = [(i, " ".join([f"a{i}"] * i + period * 40)) for i in range(2)]
    got = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(r["n_words"] for r in got) == 360 and agreeing[0].count() == 0


def test_chaining_of_long_runs_of_a_word_beside_short_ones(spark):
    """Runs of 40 words agree with runs of 56 but give no passage; as pivots they stand for none."""
    rng = random.Random(77)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(i, " ".join(words(30) + ["the"] * (56 if i % 3 == 0 else 40) + words(30))) for i in range(120)]
    got = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {d for r in got for d in (r["doc_id"], r["other_doc_id"])} == set(range(0, 120, 3))
    assert all(r["n_words"] == 56 == r["matched_words"] for r in got) and len(got) <= 4 * 40


def test_passages_of_a_pair_that_cover_the_others():
    """A passage of four places in one text and five in the other; one that reaches further stays, too; any cuts into batches."""
    rows = [(9, 60 * i, 55, 4, 70 * j, 55, 55, 1.0) for i in range(4) for j in range(5)] + [(9, 30, 100, 4, 400, 100, 90, 0.9), (10, 0, 50, 4, 0, 50, 50, 1.0)]
    rows.sort(key=lambda r: (r[0], r[3], -r[2] - r[5], -r[6], r[1], r[4]))
    for size in (1, 3, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i : i + size])], chaining._OUT) for i in range(0, len(rows), size)]
        got = [r for b in chaining._needed(iter(batches)) for r in b.to_pylist()]
        assert [(r["doc_id"], r["n_words"]) for r in got].count((9, 100)) == 1 and got[-1]["doc_id"] == 10 and len(got) < 4 + 5 + 2
        for col, own, n in ((1, "start_word", "n_words"), (4, "other_start_word", "other_n_words")):
            assert all(any(g["doc_id"] == r[0] and g[own] <= r[col] and g[own] + g[n] >= r[col] + r[col + 1 if col == 4 else 2] for g in got) for r in rows)


def test_context_links_against_all_pairs(spark, monkeypatch):
    """All pairs of surroundings that agree, in tiles of any size; pairs of one pivot are left out."""
    from heddle.llm import seeds

    rng = random.Random(33)
    texts = [[rng.choice("abcdefghijkl") for _ in range(rng.randrange(20))] + list("uvwxyz") + [rng.choice("abcdefghijkl") for _ in range(rng.randrange(20))] for _ in range(40)]
    spots = [(7, i, w.index("u"), rng.choice([0, 0, 1, 2, 3])) for i, w in enumerate(texts)]

    def both(x, y):
        (_, i, p, s), (_, j, q, t) = x, y
        lcs = lambda a, b: chaining._edit(np.array(a), np.array(b))
        return i > j and not s & t and lcs(texts[i][max(0, p - 15) : p], texts[j][max(0, q - 15) : q]) + lcs(texts[i][p + 6 :][:15], texts[j][q + 6 :][:15]) >= 9

    want = {(x[1], y[1]) for x in spots for y in spots if both(x, y)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for tile in (1024, 5):
        monkeypatch.setattr(seeds, "TILE", tile)
        got = seeds.context_links(docs, spark.createDataFrame(spots, "h long, doc long, pos int, stands int"), 6, 15, 9).collect()
        assert {(r["doc"], r["odoc"]) for r in got} == want and len(got) == len(want) > 20


def test_chaining_edges(spark, docs):
    assert chaining.fuzzy_passages(docs.where("false")).count() == 0
    assert chaining.fuzzy_passages(docs).count() > 0


def test_chaining_extends_only_the_ends_of_a_chain_that_passes_whole(monkeypatch):
    rng = random.Random(5)
    x = [rng.randrange(1, 1 << 30) for _ in range(400)]
    y = x.copy()
    for i in range(10, 400, 20):
        y[i] = -i
    chain = [(i + 1, i + 1, 19) for i in range(30, 350, 20)]
    calls, plain = [], chaining._extend
    monkeypatch.setattr(chaining, "_extend", lambda *a: calls.append(0) or plain(*a))
    got = chaining.align(chain, np.array(x, np.int32), 0, np.array(y, np.int32), 0, 50, 0.75)
    assert len(got) == 1 and got[0][1] == got[0][3] and got[0][4] >= 0.9 * got[0][1]
    assert len(calls) == 2


def test_common_words_as_bits_equal_the_table():
    rng = np.random.default_rng(4)
    for width in (1, 8, 44, 64, 70):
        x, y = rng.integers(0, 9, (2, 50, width))
        plain = []
        for a, b in zip(x, y):
            row = [0] * (width + 1)
            for v in a:
                row = [0, *itertools.accumulate((max(row[j + 1], row[j] + (v == b[j] and v != 0)) for j in range(width)), max)]
            plain.append(row[-1])
        assert seeds._common(x, y).tolist() == plain


@pytest.mark.parametrize(("k", "w", "repeats"), [(6, 8, False), (26, 25, True)])
def test_seeds_of_many_texts_at_once_equal_those_of_each(spark, k, w, repeats):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 130))) for _ in range(60)] + [None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for least in (k, 50):
        got = {(r["doc"], r["pos"]) for r in seeds.seed_rows(df, k, w, least, repeats).collect()}
        want = set()
        for i, t in enumerate(texts):
            h = words.Words(pa.array([t or ""])).h
            v = words.windows(h, k).tolist() if len(h) >= max(least, k) else []
            size = min(w, len(v))
            low = {j for a in range(len(v) - size + 1) for j in range(a, a + size) if v and v[j] == min(v[a : a + size])}
            want |= {(i, j) for j in low if repeats or not any(v[p] == v[j] and j - p <= w for p in low if p < j)}
        assert got == want


def test_periodic_stretches_lie_on_few_diagonals(spark):
    rng = random.Random(8)
    make = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    texts = [make(20 + i) + ["is", "so"] * n + make(20) for i, n in enumerate((200, 150, 60, 200))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_array.repeated_passages(df).collect()
    assert len(got) <= 60  # a row a step would be some hundreds
    covered = collections.defaultdict(set)
    for r in got:
        a, b, n = r["start_word"], r["other_start_word"], r["n_words"]
        assert texts[r["doc_id"]][a : a + n] == texts[r["other_doc_id"]][b : b + n]
        covered[r["doc_id"]].update(range(a, a + n))
    for i, t in enumerate(texts):
        assert {j for j, w in enumerate(t) if w in ("is", "so")} <= covered[i]


def test_linked_runs_against_all_pairs(spark, monkeypatch):
    """Runs that are cut by batches and by the ends of partitions; keys of one document and keys that only one partition knows to be hot."""
    rng = random.Random(21)
    rows = sorted({(h, rng.randrange(1 if h % 7 == 0 else 40), rng.randrange(60)) for h in range(60) for _ in range(rng.choice([1, 2, 3, 4, 5, 30]))})
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    links = {(x[1], x[2], y[1], y[2]) for v in by.values() if len(v) <= 4 for x in v for y in v if x[1] > y[1]}
    hot = {r for v in by.values() if len(v) > 4 and len({r[1] for r in v}) > 1 for r in v}
    df = spark.createDataFrame([(*r, r[2] + 1) for r in rows], "h long, doc long, pos int, at int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, stream in ((1, 1), (4, 50), (37, 1 << 17)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            for own in (True, False):
                monkeypatch.setattr(seeds, "_STREAM", stream)
                got, rest = seeds.linked_runs(df, 4, own)
                got, rest = [(r["doc"], r["pos"], r["odoc"], r["opos"], r["at"] - r["pos"], r["oat"] - r["opos"]) for r in got.collect()], [tuple(r) for r in rest.collect()]
                assert {r[:4] for r in got} == links and {r[4:] for r in got} == {(1, 1)} and len(rest) == len(set(rest)) and set(rest) == (hot if own else set())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_in_any_batches():
    rng = random.Random(22)
    rows = sorted((h, rng.randrange(9), rng.randrange(99)) for h in range(12) for _ in range(rng.randrange(1, 9)))
    h, doc, pos = (np.array(c, np.int64) for c in zip(*rows))
    said = []
    for size in (1, 5, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (h, doc, pos, pos)], ["h", "doc", "pos", "at"]) for i in range(0, len(rows), size)]
        plain, seeds._STREAM = seeds._STREAM, 3
        try:
            said.append(sorted(tuple(r.values()) for b in seeds._runs(4, True)(iter(batches)) for r in b.to_pylist()))
        finally:
            seeds._STREAM = plain
    assert said[0] == said[1] == said[2] and {r[-1] for r in said[0]} == {seeds.LINK, seeds.HOT, seeds.EDGE}


def test_words_of_requests_without_moving_texts(spark):
    """Requests go to the stored words: one exchange, that of the requests."""
    rng = random.Random(23)
    texts = [[f"w{rng.randrange(50)}" for _ in range(n)] for n in (60, 10, 80, 50)]
    stored = seeds.stored_words(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 50)
    asked = [(i, a, a + n) for i in range(4) for a, n in ((-5, 20), (0, 6), (40, 100), (90, 5))]
    df = spark.createDataFrame(asked, "doc long, a int, b int")
    got = seeds.with_words(stored, df.hint("merge"), "doc", F.col("a"), F.col("b"), "words")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    number = lambda w: int(words.Words(pa.array([w])).h[0] >> np.uint64(32))
    want = {(i, a, b): [number(w) for w in texts[i][max(a, 0) : max(b, 0)]] for i, a, b in asked if len(texts[i]) >= 50}
    assert {(r["doc"], r["a"], r["b"]): [v % (1 << 32) for v in r["words"]] for r in got.collect()} == want


def test_many_anchors_at_once_align_as_each():
    rng = random.Random(24)

    def edited(w, p):
        out = []
        for v in w:
            out += rng.choice([[rng.randrange(99)], [], [v, rng.randrange(99)]]) if rng.random() < p else [v]
        return out

    rows = []
    for _ in range(2000):
        p, left, mid, right = rng.choice([0.02, 0.1, 0.2, 0.4]), *([rng.randrange(99) for _ in range(n)] for n in (60, rng.randrange(6, 60), 60))
        sides = []
        for own in ((left, right), (edited(left, p), edited(right, p))):
            before, after = own[0][-rng.choice([50, 50, 9, 1]) :], own[1][: rng.choice([50, 50, 20, 0])]
            start = rng.randrange(50, 90) if len(before) == 50 else len(before)
            sides.append((start, before + mid + after))
        rows.append((*sides[0], *sides[1], len(mid)))
    x, b, y, a, n = zip(*rows)
    cut = lambda w: np.append(0, np.cumsum([len(v) for v in w]))
    flat = lambda w: np.array([v for r in w for v in r], np.int32)
    row, *found = chaining.align_anchors(np.array(x), np.array(y), np.array(n), flat(b), cut(b)[:-1], cut(b)[1:], flat(a), cut(a)[:-1], cut(a)[1:], 50, 0.75)
    want = [(i, *p) for i, r in enumerate(rows) for p in chaining.align([(r[0], r[2], r[4])], np.array(r[1], np.int32), max(0, r[0] - 50), np.array(r[3], np.int32), max(0, r[2] - 50), 50, 0.75)]
    assert list(zip(row.tolist(), *(v.tolist() for v in found))) == want and 100 < len(want) < 1900
