"""Cost-balanced packing of token sequences.

A piece of n tokens costs n + n * n / capacity (linear layers plus attention inside the piece). Whole sequences are cut off
the front of long documents where they are tokenised; what remains of each document, always shorter than a sequence, is
dealt by hash over packing groups of a few hundred sequences, and each group is packed by itself: pieces in descending order
go to the lowest-cost sequence with enough room; when none has room for the whole piece, the lowest-cost open sequence
takes as much as it holds and the rest goes back in line. A group opens exactly as many places as it has tokens: full
sequences and, for the last part, sequences of power-of-two lengths, so nothing is padded. A piece's group follows from the place of its row in
the scan (partition and number), not from its values, so that no document, source or key, nor any number of equal rows, can make a group large.
The input must be a stored table, whose scan gives its rows in one order; write other inputs first.

Defined cases. Null or empty text: just the end token. Rows that repeat a doc_id are packed each on its own. Null doc_id is packed, too.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bpe_job import pieces

CAPACITY = 4096


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Packs descending lengths: ``(item, start in item, length, sequence, offset)`` rows; every place is filled."""
    total = sum(lengths)
    rest = total % capacity
    room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    left = np.array(room, np.int64)
    cost = np.zeros(len(room))
    line = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(line)
    out = []
    while line:
        n, item, start = heapq.heappop(line)
        n = -n
        fits = left >= n
        free = fits if fits.any() else left > 0
        s = int(np.where(free, cost, np.inf).argmin())
        take = min(n, int(left[s]))
        out.append((item, start, take, s, room[s] - int(left[s])))
        left[s] -= take
        cost[s] += take + take * take / capacity
        if take < n:
            heapq.heappush(line, (take - n, item, start + take))
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_COLUMNS = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 6_000_000) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost``.

    ``group_bytes`` is the text that a packing group holds on average.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    size = src.agg(F.sum(F.octet_length("text") + 4)).first()[0] or 0
    groups = int(size) // group_bytes + 1

    def tokenise(batches):
        enc = bpe.encoder(vocabulary)
        wide = max(enc.voc.tokens) > 0xFFFF
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch):
                rows = {k: [] for k in ("row", "start", "length", "crc", "tokens", "ids", "place")}
                for r, ids in enumerate(enc.batch(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id))
                    n = len(ids)
                    cut = n - n % capacity
                    for a in [*range(0, cut, capacity), *([cut] if cut < n else [])]:
                        whole = a < cut
                        piece = ids[a : a + capacity]
                        for k, v in (("row", r), ("start", a), ("length", len(piece)), ("crc", _crc(piece) if whole else None), ("tokens", n), ("ids", None if whole else piece.astype("<u4" if wide else "<u2").tobytes()), ("place", place + r)):
                            rows[k].append(v)
                place += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows["row"], pa.int64())), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "tokens")), pa.array(rows["ids"], pa.binary()), pa.array(rows["place"], pa.int64())],
                    ["doc_id", "start", "length", "crc", "tokens", "ids", "place"],
                )

    def pack_group(key, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("tokens", "ascending")])
        doc, start, length, crc, tokens, blobs = (table.column(c).to_pylist() for c in ("doc_id", "start", "length", "crc", "tokens", "ids"))
        whole = [i for i, b in enumerate(blobs) if b is None]
        part = [i for i, b in enumerate(blobs) if b is not None]
        width = "<u4" if any(len(blobs[i]) == 4 * length[i] for i in part) else "<u2"
        found = [(i, 0, length[i], n, 0, crc[i]) for n, i in enumerate(whole)]
        for k, a, n, s, o in assign([length[i] for i in part], capacity):
            ids = np.frombuffer(blobs[part[k]], width)[a : a + n]
            found.append((part[k], a, n, s + len(whole), o, _crc(ids)))
        group = key[0].as_py()
        cols = [
            pa.array([doc[x[0]] for x in found], table.schema.field("doc_id").type),
            pa.array([start[x[0]] + x[1] for x in found], pa.int64()),
            pa.array([x[2] for x in found], pa.int64()),
            pa.array([x[5] for x in found], pa.int64()),
            pa.array([tokens[x[0]] for x in found], pa.int64()),
            pa.array([group + groups * x[3] for x in found], pa.int64()),
            pa.array([x[4] for x in found], pa.int64()),
            pa.array([x[2] + x[2] * x[2] / capacity for x in found], pa.float64()),
        ]
        return pa.Table.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

    parts = src.mapInArrow(tokenise, f"doc_id {kind}, start long, length long, crc long, tokens long, ids binary, place long")
    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("place", "start"), F.lit(groups))).drop("place")
    out = dealt.groupBy("grp").applyInArrow(lambda key, t: pack_group(key, t.drop_columns(["grp"])), _COLUMNS.format(kind=kind))
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
