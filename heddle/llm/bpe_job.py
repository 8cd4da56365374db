"""BPE over a table: token ids, digests and decoded text of a text column as one narrow Arrow stage (no shuffle)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row; null text gives an empty list."""

    def run(batches):
        enc = bpe.encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch):
                ids = enc.batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype("int32") for x in ids], pa.list_(pa.int32()))], ["id", "ids"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)``: the text that the ids stand for, by the incremental decoder; null ids give null."""

    def run(batches):
        back = bpe.TextDecoder(bpe.encoder(vocabulary).voc)
        for batch in batches:
            text = [None if ids is None else "".join(back.feed(ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: round-trip digests without moving ids or texts."""

    def run(batches):
        enc = bpe.encoder(vocabulary)
        back = bpe.TextDecoder(enc.voc, shown=True)
        decimal = [str(i).encode() for i in range(len(back.table))]

        def text_digest(ids: list[int]) -> str:
            digest = hashlib.sha256()
            for piece in back.feed(ids):
                digest.update(piece.encode())
            return digest.hexdigest()

        for batch in batches:
            for part in pieces(batch):
                rows = [x.tolist() for x in enc.batch(part.column(1).to_pylist())]
                ids = [hashlib.sha256(b" ".join(map(decimal.__getitem__, x))).hexdigest() for x in rows]
                text = [text_digest(x) for x in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n", "a", "b"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n long, a string, b string")
    return out.withColumnsRenamed({"id": id_col, "n": "n_tokens", "a": "ids_sha256", "b": "decoded_sha256"})


def pieces(batch: pa.RecordBatch, rows: int = 512):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
