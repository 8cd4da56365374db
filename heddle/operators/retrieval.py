"""Hybrid retrieval: BM25, exact vector search, weighted rank fusion, entity de-duplication, hydration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import CHUNK_WEIGHTS
from ..sources.scratch import counted, stored


def term_rows(chunks: DataFrame, text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    """One row a token: ``(chunk_id, term)``."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.explode(text.tokens(F.col(text_col))).alias("term"))


def term_frequencies(chunks: DataFrame, text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    return term_rows(chunks, text_col, id_col).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: ``(n, avgdl)``; chunks without tokens count."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(text.tokens(F.col(text_col)))), F.lit(0)).alias("total")).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


@dataclass
class Bm25Index:
    """Index tables: postings (term, chunk_id, tf), terms (term, df, idf), lengths (chunk_id, dl), stats (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame


#: Stands in every chunk once, so that counts of chunks come out of the same pass as counts of terms. No token is empty.
EVERY = ""


def _marked(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(EVERY)), tokens)


def build_index(chunks: DataFrame, text_col: str = "text", id_col: str = "chunk_id") -> Bm25Index:
    """Index tables from one pass over the texts, stored as ``(chunk_id, term, tf)``."""
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(_marked(F.coalesce(text.tokens(F.col(text_col)), F.array().cast("array<string>")))).alias("term"))
    every = stored(rows.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    postings = every.where(F.col("term") != EVERY)
    lengths = every.groupBy("chunk_id").agg((F.sum("tf") - 1).alias("dl"))
    stats = every.agg(F.count_if(F.col("term") == EVERY).alias("n"), F.coalesce(F.sum("tf"), F.lit(0)).alias("t")).select("n", ((F.col("t") - F.col("n")) / F.greatest("n", F.lit(1))).alias("avgdl"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", inverse_frequency(F.col("n"), F.col("df")).alias("idf"))  # stats: one row
    return Bm25Index(postings, terms, lengths, stats)


def read_index(spark: SparkSession, path: str) -> Bm25Index:
    """The index tables that ``sinks.write_index`` wrote."""
    return Bm25Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "lengths", "stats")))


def chunk_terms(chunks: DataFrame, text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    """``(chunk_id, term)``: each term of a chunk once, without a shuffle (rows that repeat a chunk id may repeat terms)."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("term"))


def inverted_lists(postings: DataFrame, block: int = 10_000) -> DataFrame:
    """``(term, block, chunks)``: the chunks of a term in blocks of ``block`` consecutive ids, so that a common term's list has bounded rows. Repeats count once."""
    return postings.groupBy("term", F.floor(F.col("chunk_id") / block).alias("block")).agg(F.sort_array(F.collect_set("chunk_id")).alias("chunks"))


def query_terms(queries: DataFrame, text_col: str = "text", id_col: str = "query_id") -> DataFrame:
    """``(query_id, term, times)``: a term counts as often as the query has it."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(text.tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, digits: int | None = 6) -> DataFrame:
    """``(query_id, chunk_id, score)`` for chunks with a positive score, straight from texts.

    One pass over the texts: only tokens that some query asks for leave it, and one mark a chunk, from which the corpus counts come.
    """
    asked = stored(query_terms(queries), "asked-terms")
    wanted = counted(stored(asked.select("term").union(chunks.sparkSession.createDataFrame([(EVERY,)], "term string")).distinct(), "wanted-terms"))
    slim = chunks.select("chunk_id", F.coalesce(text.tokens(F.col("text")), F.array().cast("array<string>")).alias("_t")).withColumn("dl", F.size("_t"))
    rows = slim.select("chunk_id", "dl", F.explode(_marked(F.col("_t"))).alias("term")).join(wanted, "term", "left_semi")
    every = stored(rows.groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf")), "asked-postings")
    tf = every.where(F.col("term") != EVERY)
    stats = every.where(F.col("term") == EVERY).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).select("n", (F.col("t") / F.greatest("n", F.lit(1))).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = df.select("term", inverse_frequency(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    weights = counted(stored(asked.join(idf, "term"), "asked-weights"))
    # Dealt by chunk, not by term: a common term is no hot key, and the sums of a chunk need no further shuffle.
    return _scored(tf.repartition("chunk_id").join(weights, "term"), k1, b, digits)


def index_scores(index: Bm25Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75, digits: int | None = 6) -> DataFrame:
    """As ``bm25_scores``, from index tables."""
    hits = query_terms(queries).join(index.postings, "term").join(index.terms, "term").join(index.lengths, "chunk_id").crossJoin(F.broadcast(index.stats))
    return _scored(hits, k1, b, digits)


def _scored(hits: DataFrame, k1: float, b: float, digits: int | None) -> DataFrame:
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("times") * F.col("idf") * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)))
    score = F.sum(part) if digits is None else F.round(F.sum(part), digits)
    return hits.groupBy("query_id", "chunk_id").agg(score.alias("score")).where("score > 0")


def top_ranked(scores: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``, ranks from 0, ties by chunk id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scores.withColumn("_n", rank).where(F.col("_n") <= k).select("query_id", (F.col("_n") - 1).alias("rank"), "chunk_id", "score")


def _best_of(q: np.ndarray, v: np.ndarray, k: int, digits: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``v`` and scores of the ``k`` best rows for each of ``q``, ties to the earlier row; ``step`` rows are scored at a time."""
    top, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
    for i in range(0, len(v), step):
        score = np.round(q @ v[i : i + step].T, digits)
        # Later rows lose ties, so a full list changes only where a score is above its last.
        at = np.flatnonzero((score > best[:, -1:]).any(1)) if best.shape[1] == k else np.arange(len(q))
        if not len(at):
            continue
        both = np.concatenate((best[at], score[at]), axis=1)
        places = np.concatenate((top[at], np.broadcast_to(np.arange(i, i + score.shape[1]), (len(at), score.shape[1]))), axis=1)
        pick = np.argsort(-both, axis=1, kind="stable")[:, :k]
        new_top, new_best = np.take_along_axis(places, pick, 1), np.take_along_axis(both, pick, 1)
        if len(at) == len(q):
            top, best = new_top, new_best
        else:
            top[at], best[at] = new_top, new_best
    return top, best


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = 20, digits: int = 6, query_block: int = 4096, vector_block: int = 65_536) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: the ``k`` largest inner products (in double arithmetic, of unit vectors the cosine) of each query vector.

    A task scores vectors against a block of queries by one matrix product and keeps ``k`` a query, so scores are never rows; the tops are ranked. Up to ``query_block`` queries are
    broadcast and the vectors stay where they are. Beyond that both sides are dealt into blocks and meet cell by cell in one shuffle, so that no query passes through the
    driver and the vectors are read once. Vectors of another length than the query's, null and empty ones and null ids take no part.
    """
    queries = stored(queries.where("query_id is not null and size(vector) > 0").select("query_id", "vector"), "query-vectors")
    rows = vectors.where("chunk_id is not null and size(vector) > 0").select("chunk_id", "vector")
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString()
    shape, names = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double", ["query_id", "chunk_id", "score"]
    n_queries = queries.count()
    if n_queries <= query_block:
        part = queries.toArrow()  # query_block rows at most
        shared = queries.sparkSession.sparkContext.broadcast(_by_length(part.column(0), part.column(1)))

        def run(batches):
            for batch in batches:
                own = _by_length(batch.column(0), batch.column(1))
                for n, (ids, q) in shared.value.items():
                    if n in own:
                        yield pa.RecordBatch.from_arrays(_hits(ids, q, *own[n], k, digits), names)

        return top_ranked(rows.mapInArrow(run, shape), k)
    n_vectors = rows.count()
    q_blocks, v_blocks = n_queries // query_block + 1, n_vectors // vector_block + 1
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    right = rows.withColumn("vb", F.pmod(F.xxhash64("chunk_id", "vector"), F.lit(v_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def cell(key, q, v):
        asked, own = (_by_length(t.column(0).combine_chunks(), t.column(1).combine_chunks()) for t in (q, v))
        found = [pa.table(_hits(*asked[n], *own[n], k, digits), names) for n in asked if n in own]
        return pa.concat_tables(found) if found else pa.table([q.column(0).slice(0, 0), v.column(0).slice(0, 0), pa.array([], pa.float64())], names)

    left, right = left.select("query_id", "vector", "qb", "vb"), right.select("chunk_id", "vector", "qb", "vb")
    return top_ranked(left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(cell, shape), k)


def _by_length(ids: pa.Array, lists: pa.Array) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Ids and matrices of vectors, by their length."""
    if isinstance(ids, pa.ChunkedArray):
        ids, lists = ids.combine_chunks(), lists.combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes).tolist():
        own = pa.array(np.flatnonzero(sizes == n))
        out[n] = ids.take(own), np.asarray(lists.take(own).flatten(), float).reshape(-1, n)
    return out


def _hits(ids: pa.Array, q: np.ndarray, chunk_ids: pa.Array, v: np.ndarray, k: int, digits: int, step: int = 512, rows: int = 2048) -> list[pa.Array]:
    """Columns of the best rows. ``step`` queries meet ``rows`` vectors at a time, so that scores take a few MB whatever the sides' sizes."""
    order = np.asarray(pc.sort_indices(chunk_ids))
    v = v[order]
    found = [_best_of(q[i : i + step], v, k, digits, rows) for i in range(0, len(q), step)]
    top, score = order[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found])
    return [ids.take(pa.array(np.repeat(np.arange(len(ids)), top.shape[1]))), chunk_ids.take(pa.array(top.ravel())), pa.array(score.ravel())]


def type_weight(chunk_type: Column, weights: dict[str, float] | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for kv in (weights or CHUNK_WEIGHTS).items() for x in kv))
    return F.coalesce(F.element_at(table, chunk_type), F.lit(1.0))


def fuse(dense: DataFrame, sparse: DataFrame, types: DataFrame, weights: dict[str, float] | None = None, k: int = 60, dense_share: float = 0.65, sparse_share: float = 0.35, digits: int | None = None) -> DataFrame:
    """``(query_id, chunk_id, chunk_type, rrf, dense_rank, sparse_rank)``: weighted reciprocal ranks, one union and one aggregate.

    ``dense`` and ``sparse`` are ranked lists; ``types`` has ``(chunk_id, chunk_type)`` and perhaps more columns, which are kept.
    Queries without a sparse hit fall back to the weighted dense score.
    """
    one = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"), F.col("score").alias("dense_score"))
    two = sparse.select("query_id", "chunk_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"), F.lit(None).cast("double").alias("dense_score"))
    both = one.unionByName(two).groupBy("query_id", "chunk_id").agg(*(F.max(c).alias(c) for c in ("dense_rank", "sparse_rank", "dense_score")))
    any_sparse = F.max(F.col("sparse_rank").isNotNull()).over(Window.partitionBy("query_id"))
    w = type_weight(F.col("chunk_type"), weights)
    rank_score = w * (F.coalesce(F.lit(dense_share) / (F.lit(k) + F.col("dense_rank") + 1), F.lit(0.0)) + F.coalesce(F.lit(sparse_share) / (F.lit(k) + F.col("sparse_rank") + 1), F.lit(0.0)))
    rrf = F.when(F.col("_any"), rank_score).otherwise(w * F.col("dense_score"))
    out = both.withColumn("_any", any_sparse).join(types, "chunk_id").withColumn("rrf", rrf if digits is None else F.round(rrf, digits))
    return out.drop("_any", "dense_score")


def best_per_entity(fused: DataFrame, entity: str, top: int = 4) -> DataFrame:
    """The first chunk of each entity in rank order, then the ``top`` entities of each query; ``place`` from 1."""
    order = [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.col("chunk_id")]
    first = fused.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", entity).orderBy(*order))).where("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= top)


def confidence(dense: DataFrame) -> DataFrame:
    """Top dense score of each query: what routing looks at (not the fused score)."""
    return dense.groupBy("query_id").agg(F.max("score").alias("confidence"))


DOCUMENT_COLUMNS = {"hi": "documents_hi", "mr": "documents_mr", "bn": "documents_bn", "ta": "documents_ta"}


def documents_in(lang: Column) -> Column:
    """The document list in a language, or in English where there is none."""
    pick = F.lit(None).cast("array<string>")
    for lg, c in DOCUMENT_COLUMNS.items():
        pick = F.when((lang == lg) & (F.size(c) > 0), F.col(c)).otherwise(pick)
    return F.coalesce(pick, F.col("documents_en"), F.array().cast("array<string>"))


def hydrate(hits: DataFrame, schemes: DataFrame, lang: Column) -> DataFrame:
    """The 15 fields of a search hit; hits without a scheme are dropped."""
    fields = ["name_en", "name_hi", "benefit_en", "eligibility_rules", "exclusion_criteria", "documents_en", "apply_steps_en", "application_url", "helpline", "ministry", "faq", "state_wise_amounts"]
    found = hits.join(schemes.withColumn("documents", documents_in(lang)), hits["scheme_id"] == schemes["id"])
    return found.select("query_id", "place", "id", "documents", *fields, F.col("chunk_type").alias("matched_chunk_type"))


def prompt_blocks(hits: DataFrame) -> DataFrame:
    """``(query_id, text)``: hydrated hits as prompt text, in order of place."""
    states = F.filter(F.transform(F.map_entries("state_wise_amounts.states"), lambda x: F.when(F.coalesce(x["value"], F.lit("")) != "", F.concat(x["key"], F.lit(": "), x["value"]))), lambda x: x.isNotNull())
    amounts = F.when(F.size(states) > 0, F.concat(F.lit("\nSTATE-WISE AMOUNTS: "), F.array_join(states, "; "))).otherwise(F.lit(""))
    steps = F.array_join(F.transform(F.slice("apply_steps_en", 1, 5), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n  ")
    block = F.concat(
        F.lit("── SCHEME: "), F.coalesce("name_en", F.lit("")), F.lit(" ("), F.coalesce("name_hi", F.lit("")), F.lit(") ──\nBENEFIT: "), F.coalesce("benefit_en", F.lit("")), F.coalesce(amounts, F.lit("")),
        F.lit("\nELIGIBILITY: "), F.coalesce(F.to_json("eligibility_rules"), F.lit("{}")), F.lit("\nEXCLUSIONS: "), F.coalesce(F.array_join(F.slice("exclusion_criteria", 1, 4), "; "), F.lit("")),
        F.lit("\nDOCUMENTS:\n  - "), F.coalesce(F.array_join(F.slice("documents_en", 1, 6), "\n  - "), F.lit("")), F.lit("\nHOW TO APPLY:\n  "), F.coalesce(steps, F.lit("")),
        F.lit("\nURL: "), F.coalesce("application_url", F.lit("")), F.lit("\nHELPLINE: "), F.coalesce("helpline", F.lit("")), F.lit("\n[matched via: "), F.coalesce("matched_chunk_type", F.lit("")), F.lit("]"),
    )
    rows = hits.select("query_id", "place", block.alias("b")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "b"))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("text"))
