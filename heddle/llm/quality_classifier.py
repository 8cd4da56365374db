"""Document quality with hierarchical empirical Bayes over hosts and paths.

1. Two logistic models (low quality, toxic) are fitted on labelled documents, at most ``train_most`` of them (taken by hash of
   the id). Features: a dozen shape measures and the ``words_most`` words whose label counts differ most (of those in four documents or more, five
   deviations out). The weight penalty is chosen among ``PENALTIES`` on a quarter of the training rows, fitted on the others. These are the bounds of this module.
2. Every document is scored in one narrow stage; p is the chance that it is bad on either count.
3. Host and path level: grouped sums of p give each host and each path (within its host) a posterior mean, shrunk towards the level
   above by the method-of-moments weight: sparse sites lean on the global rate, homogeneous levels collapse to it.
4. The document's own odds are moved by the odds of its path (without the document itself) over the global odds.

Defined cases. Null text: scored as empty. Null host or path: a site of its own. No usable labels: every document gets the prior
and stays. Label rows with null are ignored; of repeated labels the worst counts. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_ids, materialize, small
from .words import NOT_LETTER, U, Words, chunks

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&<>"]] = True
_PIPE = np.arange(256) == ord("|")
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_MARK = np.isin(np.arange(256), [ord(c) for c in "!?.,;:"])
SHAPES = 11
PENALTIES = (0.05, 0.2, 0.8)
#: Sites that are broadcast at most; beyond, a shuffle that splits large ones.
SITES = 300_000


def _counts(buf: np.ndarray, off: np.ndarray, mask: np.ndarray) -> np.ndarray:
    lo, hi = int(off[0]), int(off[-1])
    return np.diff(np.searchsorted(np.flatnonzero(mask[buf[lo:hi]]) + lo, off)).astype(np.float64)


def shapes(w: Words) -> np.ndarray:
    """Shape measures of each row: one row of ``SHAPES`` numbers."""
    n = np.diff(w.first).astype(np.float64)
    size = np.diff(w.offsets).astype(np.float64)
    per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)
    same = np.zeros(len(w.h) + 1)
    same[1:-1] = np.cumsum(w.h[1:] == w.h[:-1]) if len(w.h) > 1 else same[1:-1]
    if len(w.h):
        same[-1] = same[-2]
    at = np.minimum(w.first, len(w.h))
    repeats = np.maximum(same[np.maximum(at[1:], 0)] - same[np.minimum(at[:-1] + 1, len(w.h))], 0) if len(w.h) else np.zeros(len(n))
    distinct = np.array([len(np.unique(w.h[a:b])) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())], np.float64) if len(n) else np.zeros(0)
    lens = np.concatenate(([0], np.cumsum(w.end - w.start)))
    letters = lens[w.first[1:]] - lens[w.first[:-1]]
    return np.column_stack([
        np.log1p(n), letters / per_word, np.minimum(_counts(w.buf, w.offsets, _SYMBOL) / per_word, 8), np.minimum(_counts(w.buf, w.offsets, _PIPE) / per_word, 4),
        _counts(w.buf, w.offsets, _DIGIT) / per_byte, _counts(w.buf, w.offsets, _UPPER) / per_byte, np.minimum(_counts(w.buf, w.offsets, _MARK) / per_word, 6),
        repeats / per_word, distinct / per_word, (n < 30).astype(float), letters / per_byte,
    ])


def _logistic(x: np.ndarray, doc: np.ndarray, word: np.ndarray, n_words: int, y: np.ndarray, l2: float = 0.2, turns: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of dense columns, of words (sparse presence) and the bias, by preconditioned accelerated gradient steps."""
    n = len(y)
    seen = np.bincount(word, minlength=n_words).astype(float)
    scale = 4 / (np.concatenate([(x * x).sum(0) + l2, seen + l2, [n]]) * (x.shape[1] + 3))
    w = np.zeros(x.shape[1] + n_words + 1)
    ahead, t = w.copy(), 1.0
    d = x.shape[1]
    for _ in range(turns):
        z = x @ ahead[:d] + np.bincount(doc, ahead[d:-1][word], n) + ahead[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([x.T @ r + l2 * ahead[:d], np.bincount(word, r[doc], n_words) + l2 * ahead[d:-1], [r.sum()]])
        new = ahead - scale * g
        if (g * (new - w)).sum() > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:d], w[d:-1], float(w[-1])


def _penalty(x: np.ndarray, doc: np.ndarray, word: np.ndarray, n_words: int, y: np.ndarray, out: np.ndarray) -> float:
    """The penalty with the least log loss on the rows ``out``, fitted on the others; the middle one where a side lacks a class."""
    if len(set(y[out])) < 2 or len(set(y[~out])) < 2:
        return PENALTIES[len(PENALTIES) // 2]
    mine = ~out[doc]
    place = np.cumsum(~out) - 1
    loss = []
    for l2 in PENALTIES:
        dense, sparse, bias = _logistic(x[~out], place[doc[mine]], word[mine], n_words, y[~out], l2, 150)
        z = x @ dense + np.bincount(doc, sparse[word], len(y)) + bias
        loss.append(float(np.logaddexp(0, np.where(y == 1, -z, z))[out].mean()))
    return PENALTIES[int(np.argmin(loss))]


class Model:
    """Weights of both heads; ``words`` are the sorted hashes of the chosen words."""

    def __init__(self, words: np.ndarray, mean: np.ndarray, std: np.ndarray, heads: list[tuple[np.ndarray, np.ndarray, float]]):
        self.words, self.mean, self.std, self.heads = words, mean, std, heads
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(words >> U(48)).astype(np.int64)] = True

    def present(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, word index) of the chosen words that rows hold, once each."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(w.h >> U(48)).astype(np.int64)])
        h = w.h[at]
        place = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ok = self.words[place] == h
        row = np.searchsorted(w.first, at[ok], side="right") - 1
        both = np.unique(row * len(self.words) + place[ok])
        return both // len(self.words), both % len(self.words)

    def bad(self, w: Words) -> np.ndarray:
        """Chance that a row is bad on some head."""
        n = len(w.first) - 1
        x = (shapes(w) - self.mean) / self.std
        row, word = self.present(w)
        good = np.ones(n)
        for dense, sparse, bias in self.heads:
            z = x @ dense + np.bincount(row, sparse[word], n)[:n] + bias
            good *= 1 / (1 + np.exp(np.clip(z, -30, 30)))
        return np.clip(1 - good, 1e-6, 1 - 1e-6)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, heads: dict[str, int], train_most: int, words_most: int = 600) -> Model:
    """Fits on labelled documents; ``heads`` maps a label column to its bad value."""
    worst = [F.max((F.col(c) == bad).cast("int")).alias(f"y{i}") for i, (c, bad) in enumerate(heads.items())]
    known = labels.where(" and ".join(f"{c} is not null" for c in (id_col, *heads))).groupBy(F.col(id_col).alias("_id")).agg(*worst)
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(train_most)
    ys = [f"y{i}" for i in range(len(heads))]
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(4)).cast("int"))
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), F.col("_own") == F.col("_id")).select("text", "fold", *ys)  # train_most rows

    def features(batches):
        for batch in batches:
            for part in chunks(batch, 0):
                w = Words(part.column(0), gap=NOT_LETTER)
                sets = [np.unique(w.h[a:b]).astype(np.int64) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(list(shapes(w)), pa.list_(pa.float64())), pa.array(sets, pa.list_(pa.int64()))], ["fold", *ys, "x", "h"])

    sample = materialize(rows.mapInArrow(features, "fold int, " + ", ".join(f"{y} int" for y in ys) + ", x array<double>, h array<long>"), "train")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    n = totals["n"]
    chosen: set[int] = set()
    if n:
        per_word = sample.select(F.explode("h").alias("h"), *ys).groupBy("h").agg(F.count(F.lit(1)).alias("c"), *(F.sum(y).alias(y) for y in ys)).where("c >= 4")
        for y in ys:
            rate = (totals[y] or 0) / n
            if 0 < rate < 1:
                z = F.abs(F.col(y) - F.col("c") * rate) / F.sqrt(F.col("c") * F.lit(rate * (1 - rate)))
                chosen |= {r[0] for r in per_word.withColumn("z", z).where("z > 5").orderBy(F.desc("z"), "h").limit(words_most).select("h").collect()}
    words = np.sort(np.array(sorted(chosen), np.int64).astype(np.uint64))
    picked = F.array_intersect("h", F.array(*(F.lit(c) for c in sorted(chosen)))) if chosen else F.array().cast("array<bigint>")
    table = sample.select("fold", *ys, "x", picked.alias("h")).toArrow() if n else None
    if table is None or not table.num_rows:
        zero = np.zeros(SHAPES)
        return Model(words, zero, zero + 1, [(zero, np.zeros(len(words)), -3.0) for _ in ys])
    x = np.array(table.column("x").to_pylist())
    mean, std = x.mean(0), x.std(0) + 1e-9
    held = table.column("h").to_pylist()
    doc = np.repeat(np.arange(len(held)), [len(s) for s in held])
    flat = np.array([v for s in held for v in s], np.int64).astype(np.uint64)
    word = np.searchsorted(words, flat)
    out, z = [], (x - mean) / std
    kept_out = np.array(table.column("fold").to_pylist()) == 0
    for y in ys:
        target = np.array(table.column(y).to_pylist(), float)
        if target.min() == target.max():
            out.append((np.zeros(SHAPES), np.zeros(len(words)), 3.0 if target.max() else -3.0))
        else:
            out.append(_logistic(z, doc, word, len(words), target, _penalty(z, doc, word, len(words), target, kept_out)))
    return Model(words, mean, std, out)


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", heads: dict[str, int] | None = None, train_most: int = 20_000, reject: float = 0.5) -> DataFrame:
    """``(id, host, path, p_doc, p_host, p_path, posterior, kept)`` for every row; ``kept`` when the chance of a bad document is under ``reject``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, heads or {"quality": 0, "toxic": 1}, train_most))

    def score(batches):
        for batch in batches:
            for part in chunks(batch, 3):
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(model.value.bad(Words(part.column(3), gap=NOT_LETTER)))], ["id", "host", "path", "p"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    scored = materialize(src.mapInArrow(score, f"id {kind}, host string, path string, p double"), "scored")
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    top = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hq").alias("q"), F.count(F.lit(1)).alias("g"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("m2"), F.sum(F.col("hn") * F.col("hn")).alias("n2")).first()
    n = top["n"] or 1
    mean = (top["s"] or 0.0) / n

    def weight(total: int, groups: int, upper: int, square: float, group_square: float, upper_square: float, spread: float) -> float:
        """How many observations the level above counts for: variance within groups over variance between them."""
        within = max((square - group_square) / max(total - groups, 1), 1e-9)
        between = (group_square - upper_square - (groups - upper) * within) / max(spread, 1e-9)
        return within / between if between > within * 1e-6 else within / (within * 1e-6)

    host_k = weight(n, top["g"] or 1, 1, top["q"] or 0.0, top["m2"] or 0.0, n * mean * mean, n - (top["n2"] or 0) / n)
    low = paths.join(hosts, "host").agg(F.count(F.lit(1)).alias("g"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("m2"), F.sum(F.col("n") - F.col("n") * F.col("n") / F.col("hn")).alias("spread")).first()
    path_k = weight(n, low["g"] or 1, top["g"] or 1, top["q"] or 0.0, low["m2"] or 0.0, top["m2"] or 0.0, low["spread"] or 0.0)
    sites = small(materialize(paths.drop("q").join(small(materialize(hosts.drop("hq"), "hosts")), "host"), "sites"), SITES)
    out = scored.join(sites, ["host", "path"])
    # Posterior means without the document itself.
    host = (F.col("hs") - F.col("p") + host_k * mean) / (F.col("hn") - 1 + host_k)
    path = (F.col("s") - F.col("p") + path_k * F.col("p_host")) / (F.col("n") - 1 + path_k)
    out = out.withColumn("p_host", host).withColumn("p_path", path)
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(_odds(F.col("p")) + _odds(F.col("p_path")) - _odds(F.lit(mean))))))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("p").alias("p_doc"), "p_host", "p_path", "posterior", (F.col("posterior") < reject).alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that the classifier rejects. Rows without an id stay; an id goes when one of its rows is rejected."""
    found = classify(docs, labels, id_col=id_col, **how)
    return drop_ids(docs, id_col, found.where("not kept").select(id_col))
