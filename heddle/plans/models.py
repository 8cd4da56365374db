"""Boundaries to models outside the engine: replies, embeddings, translations. Each takes a factory, called once in a worker.

Python stages run for every row they are given: filter before them (see ``guardrail.undecided``) and put distinct texts through
them, as ``translated`` does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch, sinks


def replies(df: DataFrame, prompt: Column, factory: Callable[[], Callable[[list[str]], list[str]]], out: str = "reply", most: int = 64) -> DataFrame:
    """``df`` with a model's reply to ``prompt``, in batches of ``most``."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for b in batches:
            texts = b.fillna("").tolist()
            yield pd.Series([r for i in range(0, len(texts), most) for r in model(texts[i : i + most])])

    return df.withColumn(out, ask(prompt))


def asked(df: DataFrame, prompt: Column, factories: list[Callable[[], Callable[[list[str]], list[str]]]], out: str = "asked", retries: int = 2, wait: float = 3.0, most: int = 64) -> DataFrame:
    """``df`` with ``out``: a struct of reply, error and the number of the model that replied.

    A failing batch is tried again ``retries`` times, after ``wait`` seconds times the try, then by the next model; when all fail the error stays with the rows.
    """

    @F.pandas_udf("reply string, error string, model int")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models: dict[int, Callable[[list[str]], list[str]]] = {}

        def one(texts: list[str]) -> list[tuple[str | None, str | None, int | None]]:
            error = None
            for n, factory in enumerate(factories):
                for turn in range(retries + 1):
                    try:
                        if n not in models:
                            models[n] = factory()
                        return [(r, None, n) for r in models[n](texts)]
                    except Exception as e:  # the boundary: any failure of a model is data
                        error = f"{type(e).__name__}: {e}"
                        if turn < retries:
                            time.sleep(wait * (turn + 1))
            return [(None, error, None)] * len(texts)

        for b in batches:
            texts = b.fillna("").tolist()
            rows = [r for i in range(0, len(texts), most) for r in one(texts[i : i + most])]
            yield pd.DataFrame({"reply": [r[0] for r in rows], "error": [r[1] for r in rows], "model": pd.array([r[2] for r in rows], "Int32")})

    return df.withColumn(out, ask(prompt))


def answered(requests: DataFrame, cache: DataFrame, now: Column, factories: list[Callable[[], Callable[[list[str]], list[str]]]], **how) -> tuple[DataFrame, DataFrame]:
    """Cache-aside: ``(answers, cache)`` for requests ``(request_id, cache_key, call_type, prompt, lang)``.

    Keys with a live entry are answered from it; of the others each key is asked once. Answers are ``(request_id, cache_key, response, hit)``; the new cache has
    the answers to misses and the hits counted. Blank or failed replies are not stored, and a request for one has a null response.
    """
    live = sinks.unexpired(cache, now).select("cache_key", F.col("response").alias("_held"))
    misses = requests.join(live, "cache_key", "left_anti").groupBy("cache_key").agg(F.min_by(F.struct("call_type", "prompt", "lang"), "request_id").alias("m")).select("cache_key", "m.*")
    new = scratch.stored(asked(misses, F.col("prompt"), factories, **how).select("cache_key", "call_type", F.col("asked.reply").alias("response"), "lang"), "replies")
    said = live.withColumn("hit", F.lit(True)).union(new.where(F.trim(F.coalesce("response", F.lit(""))) != "").select("cache_key", "response", F.lit(False)))
    answers = requests.join(said, "cache_key", "left").select("request_id", "cache_key", F.col("_held").alias("response"), F.coalesce("hit", F.lit(False)).alias("hit"))
    return answers, sinks.cache_put(sinks.with_hits(cache, answers.where("hit").select("cache_key")), new, now)


def embeddings(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "passage: ", out: str = "vector", most: int = 64) -> DataFrame:
    """``df`` with unit vectors of a text column; passages and queries carry their own prefix."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for b in batches:
            texts = (prefix + b.fillna("")).tolist()
            yield pd.Series([v for i in range(0, len(texts), most) for v in model(texts[i : i + most])])

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))

    raw = df.withColumn("_raw", embed(F.col(text_col))).withColumn("_norm", norm(F.col("_raw")))
    return raw.withColumn(out, F.transform("_raw", lambda x: (x / F.col("_norm")).cast("float"))).drop("_raw", "_norm")


def translated(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], list[str]]], out: str) -> DataFrame:
    """``df`` with translations: every distinct text goes through the model once; a null or blank result keeps the text."""
    texts = df.select(F.col(text_col).alias("_t")).where(F.col(text_col).isNotNull()).distinct()
    done = replies(texts, F.col("_t"), factory, "_r")
    joined = df.join(done, df[text_col] == done["_t"], "left")
    return joined.withColumn(out, F.when(F.trim(F.coalesce("_r", F.lit(""))) != "", F.col("_r")).otherwise(F.col(text_col))).drop("_t", "_r")
