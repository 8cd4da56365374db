"""Rules with certified cutoffs and the empirical Bayes classifier."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from heddle.llm import quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_measures(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t\x0b", "a", "a b", "a b c", "a a a a", "a b c a b c", "x|y ## $$$\nx|y ## $$$\n\n \nx", "é ñ\x1cq 🎉🎉", "a b c d a b c", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)), "\n".join(["same line of words"] * 30), "w " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.text_measures(df).collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts)}


def tail(k, n, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 2, 10, 100, 700, 1000) for k in sorted({0, 1, n // 300, n // 150, n // 110}) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        want = 1.0 if r["k"] >= r["n"] * 0.01 else tail(r["k"], r["n"], 0.01)
        assert r["p"] == pytest.approx(want, rel=1e-9)
    big = spark.createDataFrame([(9_000_000, 1_000_000_000)], "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01)).first()["p"]
    assert 0 <= big < 1e-200


def holdout(rng, n, bad_share=0.3):
    rows = []
    for i in range(n):
        bad = rng.random() < bad_share
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 90))]
        text = " ".join(w + "%%%" if bad and rng.random() < 0.9 else w for w in words)
        rows.append((i, text, "en" if i % 3 else None, 0 if bad else 1))
    return rows


def test_judge_rejects_junk_and_keeps_the_promise(spark):
    rows = holdout(random.Random(1), 3000)
    docs = spark.createDataFrame([(i, t, lg) for i, t, lg, _ in rows] + [(9001, None, "xx"), (9002, "too short", "en"), (None, "x " * 60, "en")], "doc_id long, text string, lang string").withColumn("stratum", F.lit("clash"))
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows[:2000]] + [(0, 7), (None, 1), (5, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert len(out) == 3003 and out[9001]["base_failed"] and out[9002]["rejected_by"] == ["base"] and not out[9001]["kept"]
    unseen = rows[2000:]
    good, bad = [r for r in unseen if r[3] == 1], [r for r in unseen if r[3] == 0]
    assert sum(not out[r[0]]["kept"] for r in good) <= 0.04 * len(good) and sum(not out[r[0]]["kept"] for r in bad) >= 0.95 * len(bad)


def test_repeated_rows_count_once_in_the_tests(spark):
    """Copies of labelled rows add nothing to the evidence: the certified cutoffs stay what they were."""
    rows = holdout(random.Random(4), 900)
    once = spark.createDataFrame([(i, t, lg) for i, t, lg, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")
    want = {r["doc_id"]: r["rejected_by"] for r in quality_rules.judge(once, labels).collect()}
    again = quality_rules.judge(once.union(once).union(once), labels).collect()
    assert len(again) == 2700 and all(r["rejected_by"] == want[r["doc_id"]] for r in again)


def test_few_or_no_labels_reject_nothing_beyond_the_base(spark):
    rows = holdout(random.Random(1), 60)
    docs = spark.createDataFrame([(i, t, lg) for i, t, lg, _ in rows], "doc_id long, text string, lang string")
    few = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")
    for labels in (few, few.where("false")):
        assert all(r["kept"] for r in quality_rules.judge(docs, labels).collect())
    assert quality_rules.judge(docs.where("false"), few).count() == 0


def test_fixed_sequence_stops_at_the_first_failure(spark):
    """With 2000 good documents and none rejected by lenient cutoffs, no certified cutoff rejects more than the risk allows."""
    rng = random.Random(6)
    rows = [("s", 100, 600, int(rng.random() * 60), 0, 0, 1) for _ in range(2000)] + [("s", 100, 600, 300, 0, 0, 0) for _ in range(500)]
    h = spark.createDataFrame(rows, "st string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality int")
    cuts = {r["rule"]: r for r in quality_rules.certified_cutoffs(h, "st", "quality").collect()}
    assert set(cuts) == {"symbols"} and cuts["symbols"]["cutoff"] >= 0.6 and cuts["symbols"]["p_value"] <= 0.05


SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    out = quality_classifier.classify(docs, train)
    counts = {(r["bad"], r["kept"]): r["count"] for r in out.join(test, "doc_id").groupBy(((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"), "kept").count().collect()}
    assert counts.get((False, False), 0) <= 0.01 * (counts[False, True] + counts.get((False, False), 0))
    assert counts[True, False] >= 0.93 * (counts[True, False] + counts.get((True, True), 0))


def test_sparse_sites_lean_on_the_global_rate(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        host = "big" if i % 3 else f"h{i % 40}"
        bad = rng.random() < (0.8 if host == "big" and i % 2 else 0.1)
        rows.append((i, ("scum " if bad else "fine ") + " ".join(f"w{rng.randrange(300)}" for _ in range(40)), host, "a" if i % 2 else "b", 0 if bad else 1))
    rows.append((5000, "fine w1 w2 w3", "new", "a", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    labels = df.where("doc_id < 800").select("doc_id", "quality", F.lit(0).alias("toxic"))
    out = {r["doc_id"]: r for r in quality_classifier.classify(df.drop("quality").withColumn("p", F.lit(1)), labels).collect()}
    mean = sum(r["p_doc"] for r in out.values()) / len(out)
    assert out[5000]["p_path"] == pytest.approx(mean, abs=0.08)
    worst = [out[i]["p_path"] for i in range(1200) if i % 3 and i % 2]
    assert min(worst) > 2 * mean * 0.8 and all(0 < r["posterior"] < 1 for r in out.values())


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, "", "s", "en"), (2, "ok text", "s", "en"), (2, "ok text", "s", "en"), (None, "x", "s", "en")], "doc_id long, text string, source string, lang string").select("*", *(F.lit(0).alias(c) for c in ("id", "host", "path", "n", "s", "y0", "y1", "_id", "fold", "x", "h")))
    labels = spark.createDataFrame([(1, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == 5 and all(r["kept"] for r in out)
    assert quality_classifier.drop_rejected(docs, labels).columns == docs.columns
    assert quality_classifier.classify(docs.where("false"), labels).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").withColumn("y0", F.lit(1))
    assert quality_classifier.classify(docs, some).count() == 5
    long = spark.createDataFrame([(i, "word " * 300_000 if i == 3 else f"some text {i}", "s", "en") for i in range(6)], "doc_id long, text string, source string, lang string")
    assert quality_classifier.classify(long, spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")).count() == 6
    one_class = spark.createDataFrame([(2, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality_classifier.classify(docs, one_class).collect())


def plain_posteriors(rows):
    """Posteriors by sums over documents: moments of each level, then each document against the others of its path and host."""
    n = len(rows)
    p = [r["p_doc"] for r in rows]
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i, r in enumerate(rows):
        hosts[r["host"]].append(i)
        paths[r["host"], r["path"]].append(i)

    def avg(own):
        return math.fsum(p[i] for i in own) / len(own)

    mean = avg(range(n))

    def pull(groups, above, upper, spread):
        within = max(math.fsum((p[i] - avg(own)) ** 2 for own in groups.values() for i in own) / max(n - len(groups), 1), 1e-9)
        between = (math.fsum(len(own) * (avg(own) - above(g)) ** 2 for g, own in groups.items()) - (len(groups) - upper) * within) / max(spread, 1e-9)
        return within / between if between > within * 1e-6 else 1e6

    host_k = pull(hosts, lambda g: mean, 1, n - sum(len(h) ** 2 for h in hosts.values()) / n)
    path_k = pull(paths, lambda g: avg(hosts[g[0]]), len(hosts), math.fsum(len(own) - len(own) ** 2 / len(hosts[g[0]]) for g, own in paths.items()))
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = []
    for i, r in enumerate(rows):
        host = (math.fsum(p[j] for j in hosts[r["host"]] if j != i) + host_k * mean) / (len(hosts[r["host"]]) - 1 + host_k)
        own = paths[r["host"], r["path"]]
        path = (math.fsum(p[j] for j in own if j != i) + path_k * host) / (len(own) - 1 + path_k)
        out.append((host, path, 1 / (1 + math.exp(-(odds(p[i]) + odds(path) - odds(mean))))))
    return out


def test_posteriors_against_sums_over_documents(spark):
    rng = random.Random(12)
    rows = []
    for i in range(700):
        host = rng.choice(["big", "big", "bad", *(f"h{k}" for k in range(25)), None])
        bad = rng.random() < {"bad": 0.9, "big": 0.2}.get(host, 0.3) * (1.5 if i % 5 == 0 else 1)
        rows.append((i, ("scum " * rng.randrange(1, 4) if bad else "fine ") + " ".join(f"w{rng.randrange(200)}" for _ in range(30)), host, f"p{i % 5}", 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    labels = df.where("doc_id < 400").select("doc_id", "quality", F.lit(0).alias("toxic"))
    got = quality_classifier.classify(df.drop("quality"), labels).collect()
    assert len(got) == 700 and len({r["p_doc"] for r in got}) > 30
    for r, (host, path, post) in zip(got, plain_posteriors(got)):
        assert r["p_host"] == pytest.approx(host, rel=1e-6) and r["p_path"] == pytest.approx(path, rel=1e-6) and r["posterior"] == pytest.approx(post, rel=1e-5)
        assert r["kept"] == (r["posterior"] < 0.5)
