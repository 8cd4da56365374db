"""Quality rules with certified cutoffs, on the native engine.

Every document gets integer text measures in one scan. The labelled rows are split by a digest of the id: a quarter selects, per
stratum (``lang``), the rules that help there (bad rejected minus ``price`` times good rejected is positive at some cutoff); the
other three quarters certify, per stratum and selected rule, how strict a cutoff may be. For a grid of cutoffs from lenient to
strict, the number k of good documents (label 1) that a cutoff would reject is tested against the hypothesis "the rule rejects
more than its share of good documents" with the exact binomial tail P(Bin(n, share) <= k). The grid is
tested in fixed order and stops at the first failure; each sequence runs at level ``delta`` divided by the number
of selected (stratum, rule) sequences (Bonferroni), so with probability 1 - delta no certified cutoff breaks its
promise anywhere. ``risk`` is the budget of a whole stratum; each rule selected in it gets an equal part. As the selecting rows
take no part in the tests, the promise holds whatever they select. Among certified cutoffs a rule takes the one with the best gain
over all labelled rows; a rule without positive gain stays off. No row is left out; thresholds never depend on a sample.

Defined cases. Null or empty text: no words, ``base_failed``. Null stratum: a stratum of its own. Strata without
labels, or with too few to certify anything: only the base rule rejects. Null or other labels are ignored. Labels repeated
with the same value count once; contradicting labels of a document count as good. Repeated rows give repeated results; in the tests a labelled
id counts once, with the smallest of its rows' measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialize, small

SYMBOLS = "#*$%&|<>"
#: rule -> (measure from the counts, cutoffs from lenient to strict, reject when over?)
RULES: dict[str, tuple[str, list[float], bool]] = {
    "symbols": ("n_symbols / n_words", [4.0, 3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1], True),
    "dup_lines": ("n_dup_lines / n_words", [0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02], True),
    "repeats": ("n_repeat_words / n_words", [0.48, 0.44, 0.4, 0.36, 0.32, 0.28, 0.24, 0.2, 0.16, 0.12, 0.08], True),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0], True),
    "short_words": ("word_chars / n_words", [1.2, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0], False),
}


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, to double precision: the Stirling series at x + 8, shifted down."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    shifted = x * (x + 1) * (x + 2) * (x + 3)
    shifted2 = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (z - 0.5) * F.log(z) - z + 0.5 * F.log(F.lit(2.0) * F.pi()) + series - F.log(shifted) - F.log(shifted2)


def binomial_tail(k: Column, n: Column, p: Column | float) -> Column:
    """P(Bin(n, p) <= k), summed from the k-th term down until terms no longer count (they fall fast below the mean).

    Returns 1 when k is at or above the mean n * p, which no test at a small level could pass anyway.
    """
    p = p if isinstance(p, Column) else F.lit(p)
    kd, nd = k.cast("double"), n.cast("double")
    log_pk = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(p) + (nd - kd) * F.log(1 - p)
    terms = F.least(k, (20 * F.sqrt(nd)).cast("long") + 50)
    zero = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))

    def step(acc, i):
        j = kd - i.cast("double")
        t = acc["t"] * (j + 1) / (nd - j) * ((1 - p) / p)
        return F.struct((acc["s"] + t).alias("s"), t.alias("t"))

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>")), zero, step, lambda acc: acc["s"])
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_pk) * total))


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_t", text).withColumn("_w", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long"))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(WHITE)) != ""))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    spots = F.sequence(F.lit(0), F.size("_w") - 3)
    df = df.withColumn("_g", F.when(F.size("_w") >= 4, F.transform(spots, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))))
    twice = F.size("_g") > F.size(F.array_distinct("_g"))
    # Only texts with a repeated window pay for the sort that finds where the repeats are.
    order = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(twice, order))
    at = F.transform("_s", lambda x, i: F.when((x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]), x["i"]))
    covered = F.array_distinct(F.flatten(F.transform(F.array_compact(at), lambda i: F.array(i, i + 1, i + 2))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(twice, F.size(covered)), F.lit(0)).cast("long"))
    return df.drop("_t", "_w", "_l", "_g", "_s")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def selects(id_col: Column) -> Column:
    """The quarter of the ids whose rows select rules and take no part in the tests."""
    return F.substring(F.md5(id_col.cast("string")), 1, 1).isin(*"0123")


def certified_cutoffs(holdout: DataFrame, stratum: str, label: str, risk: float = 0.04, delta: float = 0.05, price: float = 3.0, selecting: str | None = None) -> DataFrame:
    """One row a stratum and rule with a usable cutoff: ``(stratum, rule, cutoff, n_good, false_rejects, p_value)``.

    ``holdout`` has the measures, the stratum and a 0/1 label of every labelled document that passes the base rule, and in
    ``selecting`` whether a row selects rules; without that column every rule is tested, on all rows.
    Work is a grouped count over (stratum, rule, cutoff); only the grid size is fixed, nothing depends on row order.
    """
    marks = []
    for rule, (measure, grid, over) in RULES.items():
        value = F.expr(measure)
        # The bucket of a document: how many of the cutoffs, from lenient to strict, leave it alone.
        hit = [((value > c) if over else (value < c)).cast("int") for c in grid]
        marks.append(F.struct(F.lit(rule).alias("rule"), F.lit(len(grid)).alias("size"), (F.lit(len(grid)) - sum(hit[1:], hit[0])).alias("bucket"), F.array(*map(F.lit, grid)).alias("grid")))
    picks = F.col(selecting).cast("long") if selecting else F.lit(0).cast("long")
    rows = holdout.select(F.col(stratum).alias("stratum"), (F.col(label) == 1).cast("long").alias("good"), picks.alias("picks"), F.explode(F.array(*marks)).alias("m"))
    tally = {"good": F.col("good"), "bad": 1 - F.col("good"), "good_picks": F.col("good") * F.col("picks"), "bad_picks": (1 - F.col("good")) * F.col("picks")}
    counts = rows.groupBy("stratum", "m.rule", "m.grid", "m.bucket").agg(*(F.sum(v).alias(c) for c, v in tally.items()))
    # Spread each stratum's few bucket counts over its grid, so that cutoffs without documents are tested too.
    cells = counts.groupBy("stratum", "rule", "grid").agg((F.sum("good") - F.sum("good_picks")).alias("n_good"), F.collect_list(F.struct("bucket", *tally)).alias("b"))
    cells = cells.select("stratum", "rule", "n_good", "b", F.posexplode("grid").alias("step", "cutoff"))

    def rejected(what: str) -> Column:
        return F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["bucket"] <= F.col("step"), x[what]).otherwise(F.lit(0).cast("long")))

    cells = cells.withColumns({f"_{c}": rejected(c) for c in tally}).drop("b").withColumn("false_rejects", F.col("_good") - F.col("_good_picks"))
    if selecting:
        helps = F.max(F.col("_bad_picks") - price * F.col("_good_picks")).over(Window.partitionBy("stratum", "rule")) > 0
        cells = cells.withColumn("helps", helps).where("helps")
    active = F.size(F.collect_set("rule").over(Window.partitionBy("stratum")))
    cells = cells.withColumn("share", F.lit(risk) / active)
    tail = binomial_tail(F.col("false_rejects"), F.col("n_good"), F.col("share"))
    cells = cells.withColumn("p_value", F.when(F.col("n_good") > 0, tail).otherwise(F.lit(1.0)))
    sequences = cells.select("stratum", "rule").distinct().agg(F.count(F.lit(1)).alias("sequences"))
    cells = cells.crossJoin(F.broadcast(sequences))  # one row
    passed = F.min((F.col("p_value") <= F.lit(delta) / F.col("sequences")).cast("int")).over(Window.partitionBy("stratum", "rule").orderBy("step"))
    good = cells.withColumn("passed", passed).where("passed = 1").withColumn("gain", F.col("_bad") - price * F.col("_good")).where("gain > 0")
    best = good.groupBy("stratum", "rule").agg(F.max(F.struct("gain", (-F.col("step")).alias("lenient"), "cutoff", "n_good", "false_rejects", "p_value")).alias("x"))
    return best.select("stratum", "rule", "x.cutoff", "x.n_good", "x.false_rejects", "x.p_value")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label: str = "quality", **certify) -> DataFrame:
    """``(id, stratum, measures, base_failed, kept, rejected_by)`` for every row of ``docs``."""
    measured = text_measures(docs.select(F.col(id_col), F.col(stratum).alias("_stratum"), F.col(text_col).alias("_text")), "_text")
    measured = measured.drop("_text").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    measured = materialize(measured.withColumn("_stratum", F.coalesce(F.col("_stratum").cast("string"), F.lit(""))), "measures")
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.max(label).alias("_label"))
    holdout = measured.where("not base_failed").join(known, measured[id_col] == known["_lid"])
    # The binomial bounds need independent rows: one a labelled id.
    row = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_stratum")
    holdout = holdout.groupBy("_lid", "_label").agg(F.min(row).alias("_row")).select("_lid", "_label", "_row.*").withColumn("_selects", selects(F.col("_lid")))
    # At most one row for each stratum: rule -> cutoff.
    cutoffs = certified_cutoffs(holdout, "_stratum", "_label", selecting="_selects", **certify).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    cutoffs = small(materialize(cutoffs.withColumnsRenamed({r: f"_cut_{r}" for r in RULES}), "cutoffs"))
    out = measured.join(cutoffs, measured["_stratum"] == cutoffs["stratum"], "left")
    hits = [F.when(F.coalesce(F.expr(f"({m}) {'>' if over else '<'} _cut_{r}"), F.lit(False)), F.lit(r)) for r, (m, _, over) in RULES.items()]
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*hits))))
    out = out.withColumn("kept", F.size("rejected_by") == 0)
    return out.select(id_col, F.col("_stratum").alias("stratum"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
