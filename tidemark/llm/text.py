"""Vectorised text helpers that run inside Spark tasks.

Texts arrive as Arrow string columns. A slice of rows is viewed as one byte
array, words and windows are hashed with prefix sums of a polynomial hash, and
no per-word Python objects are made. Whitespace is the six ASCII characters
``[\\x20\\x09-\\x0D]``; they never occur inside a multi-byte UTF-8 sequence.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARK = np.zeros(256, bool)   # ASCII punctuation
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_INV_BASE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept between calls)."""
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = _table(_BASE, n), _table(_INV_BASE, n)
    return _POW[:n], _INV[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[i] = hash sum of data[:i]; see :func:`span_hash`."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:len(data)], out=out[1:])
    return out


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes."""
    _, inv = powers(len(c))
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64))


@dataclass
class Bytes:
    """Rows [lo, hi) of a string column as one byte array."""
    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray   # first byte of each row, relative to data
    end: np.ndarray


@dataclass
class Words:
    """Words of a :class:`Bytes` slice, in order."""
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray   # for each row, index of its first word; one more entry at the end
    hash: np.ndarray


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Bytes]:
    """Cut a string column into row ranges of at most ``limit`` bytes (a longer
    single row stands alone). Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    col = column.fill_null("").cast(pa.large_binary())
    _, offs, buf = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Bytes(lo, hi, raw[off[lo]:off[hi]], off[lo:hi] - off[lo], off[lo + 1:hi + 1] - off[lo])
        lo = hi


def words(b: Bytes, lower: bool = True) -> Words:
    """Maximal runs of non-space bytes, never across rows, with their hashes
    (A-Z lower-cased first when ``lower``)."""
    d = (_LOWER if lower else _SAME)[b.data]
    n = len(d)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(b.start) + 1, np.int64), np.zeros(0, np.uint64))
    solid = ~_SPACE[d]
    cut = np.zeros(n + 1, bool)
    cut[b.start] = True
    cut[b.end] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | cut[1:n]
    s = np.flatnonzero(begin)
    e = np.flatnonzero(stop) + 1
    first = np.searchsorted(s, np.append(b.start, n))
    return Words(s, e, first, span_hash(prefix_hash(d), s, e))


def lowered(b: Bytes) -> np.ndarray:
    return _LOWER[b.data]


def spaced(b: Bytes) -> Bytes:
    """``b`` with white space outside ASCII (no-break, ideographic, general
    punctuation spaces and line ends) as ASCII spaces of equal length."""
    d = b.data
    p = np.flatnonzero((d == 0xC2) | ((d >= 0xE1) & (d <= 0xE3)))
    pad = np.concatenate([d, np.zeros(2, np.uint8)])
    x, y, z = pad[p], pad[p + 1], pad[p + 2]
    two = (x == 0xC2) & ((y == 0xA0) | (y == 0x85))
    general = (x == 0xE2) & (((y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
    three = general | ((x == 0xE3) & (y == 0x80) & (z == 0x80)) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80))
    if not (two | three).any():
        return b
    d = d.copy()
    for k, at in ((0, p[two | three]), (1, p[two | three]), (2, p[three])):
        d[at + k] = 0x20
    return Bytes(b.lo, b.hi, d, b.start, b.end)


def cut_runs(b: Bytes, w: Words, c: np.ndarray, whole: int, over: int, inside: np.ndarray | None = None) -> tuple[Words, np.ndarray]:
    """``w`` with runs longer than ``whole`` bytes cut into consecutive pieces
    between characters, so that every byte is in a short word; and how far the
    n-grams of each piece reach: ``over`` bytes into the next one, at most
    ``whole`` in all. Hashes of pieces are of these bytes (``c`` is the prefix
    hash). Such runs are first cut after ASCII punctuation, and all runs at the
    positions ``inside``."""
    s, e, h = w.start, w.end, w.hash
    inside = np.zeros(0, np.int64) if inside is None else inside
    big = np.zeros(len(b.data) + 1, np.int8)
    np.add.at(big, s[e - s > whole], 1)
    np.add.at(big, e[e - s > whole], -1)
    if big.any():
        mark = _MARK[b.data]
        p = np.flatnonzero(np.cumsum(big[:-1], dtype=np.int8).astype(bool) & ~mark)
        inside = np.union1d(inside, p[(p > 0) & mark[p - 1]])
    inside = np.setdiff1d(inside, s)
    if len(inside):
        parts = np.union1d(s, inside)
        run = np.searchsorted(s, parts, "right") - 1
        end = np.minimum(np.append(parts[1:], len(b.data)), e[run])
        same = (parts == s[run]) & (end == e[run])
        h = np.where(same, h[run], span_hash(c, parts, end))
        s, e = parts, end
    step = whole - over - 3             # a cut moves back by up to three bytes
    many = np.where(e - s > whole, -(-(e - s - whole + 3) // step) + 1, 1)
    if len(s) == len(w.start) and not (many > 1).any():
        return w, e
    run = np.repeat(np.arange(len(s)), many)
    k = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    start = s[run] + k * step
    for _ in range(3):
        start -= (k > 0) & ((b.data[start] & 0xC0) == 0x80)
    end = np.where(k + 1 < many[run], np.append(start[1:], 0), e[run])
    reach = np.minimum(end + over, e[run])
    h = h[run]
    new = many[run] > 1
    h[new] = span_hash(c, start[new], reach[new])
    return Words(start, end, np.searchsorted(start, np.append(b.start, len(b.data))), h), reach


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents whose labels are never learned from:
    crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 5 == 0
