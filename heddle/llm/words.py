"""Vectorised word hashing of Arrow text columns: the shared front end of the shingle and seed operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes never occur inside a
multi-byte UTF-8 sequence, so bytes can be scanned as they are. With ``fold`` A-Z count as a-z.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words longer than this many bytes are hashed one by one.
LONG = 256
_PLAIN = np.arange(256, dtype=np.uint8)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters and the bytes of non-ASCII characters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: The low n bytes of a lane.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its offsets (one more than rows); null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


class Words:
    """Words of a batch: ``h`` hash, ``start``/``end`` byte positions in ``buf``; doc i has words first[i]:first[i+1]."""

    __slots__ = ("buf", "end", "first", "h", "offsets", "start")

    def __init__(self, col: pa.Array, fold: bool = True, gap: np.ndarray = _GAP):
        buf, off = text_bytes(col)
        lo, hi = int(off[0]), int(off[-1])
        part = buf[lo:hi]
        word = ~gap[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[off - lo] = True
        begins = word & edge[:-1]
        begins[1:] |= word[1:] & ~word[:-1]
        ends = word & edge[1:]
        ends[:-1] |= word[:-1] & ~word[1:]
        self.start = np.flatnonzero(begins) + lo
        self.end = np.flatnonzero(ends) + lo + 1
        self.first = np.searchsorted(self.start, off)
        self.buf, self.offsets = buf, off
        self.h = _hash(buf, self.start, self.end, _FOLDED if fold else _PLAIN)


def _hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: lanes of eight bytes, mixed one after the other; a digest for very long words."""
    size = end - start
    out = size.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    if not len(start):
        return out
    lo = int(start[0])
    own = np.concatenate([letters[buf[lo : int(end[-1])]], np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(own) - 7, "<u8", own, strides=(1,))
    rows = np.flatnonzero(size <= LONG)
    at, left = start[rows] - lo, size[rows]
    while len(rows):
        h = (out[rows] ^ (lanes[at] & _LOW[np.minimum(left, 8)])) * U(0xC2B2AE3D27D4EB4F)
        out[rows] = h ^ (h >> U(32))
        more = np.flatnonzero(left > 8)
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        word = own[start[i] - lo : end[i] - lo].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return mix(out)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of ``h`` (empty when there are fewer words), put together from windows of powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size = None, 0, 1
    while True:
        if k & size:
            part = h[at : at + n]
            out = part.copy() if out is None else mix(out * U(0xC2B2AE3D27D4EB4F) + part)
            at += size
        if 2 * size > k:
            return mix(out)
        h = mix(h[:-size] * U(0x9E3779B97F4A7C15) + h[size:])
        size *= 2


def chunks(batch: pa.RecordBatch, col: int, most: int = 1 << 22):
    """Slices of a batch whose text is about ``most`` bytes at most, so that working arrays stay small."""
    _, off = text_bytes(batch.column(col))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
