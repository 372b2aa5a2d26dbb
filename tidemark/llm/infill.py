"""Fill-in-the-middle transformation (op 13) with a sparse exception index.

A text is cut into a prefix, a middle and a suffix, and written with the
sentinels ``<P>``, ``<S>``, ``<M>`` in one of two orders: ``psm`` (prefix,
suffix, middle) or ``spm`` (suffix, prefix, middle). The choice and the cuts come
from a hash of the seed and the ``doc_id``, so a document always gets the same
form. Texts that hold a sentinel stay ``plain``, so every output can be undone
(:func:`restore`).

Cuts lie between words (a word with the white space before it; white space at
the end is a unit of its own) or between code points. Texts are bytes: words end
where bytes say so, and the two kinds of positions are converted by a
:class:`CharIndex` that records only the multibyte characters, their places and
their excess bytes. In ASCII spans the two differ by a constant, so a conversion
is one ``searchsorted`` and one addition, and a text without multibyte characters
costs nothing.

Everything is per document: one pass over the rows, no shuffle, memory bounded by
a batch and the longest text.

Defined results: null text is empty; empty texts are plain with n = 0; a text of
white space only is one unit; a null ``doc_id`` hashes as an empty string; every
row stands alone, so rows that repeat an id are transformed alike; further
columns are dropped unless named in ``keep``.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Bytes, slices

SEED = 42
RATE = 50    # per cent of the texts that are transformed
SPM = 80     # per cent of those that are written suffix first
PRE, SUF, MID = b"<P>", b"<S>", b"<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_EXCESS = np.zeros(256, np.int64)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:] = 1, 2, 3


class CharIndex:
    """Byte places of the multibyte characters of UTF-8 ``data``, their code-point
    places, and the excess bytes before each (one more entry: of all)."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        self.excess = np.concatenate([[0], np.cumsum(_EXCESS[data[self.at_byte]])])
        self.at_char = self.at_byte - self.excess[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before each byte cut (cuts lie between characters)."""
        return cut - self.excess[np.searchsorted(self.at_byte, cut)]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return cut + self.excess[np.searchsorted(self.at_char, cut)]


def word_cuts(b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all words of the slice; for each row the index of its first end,
    and its number of units."""
    d = b.data
    if len(d) == 0:
        none = np.zeros(len(b.start), np.int64)
        return np.zeros(0, np.int64), none, none
    solid = ~_SPACE[d]
    stop = solid.copy()
    edge = np.zeros(len(d) + 1, bool)
    edge[b.start] = True
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    ends = np.flatnonzero(stop) + 1
    first = np.searchsorted(ends, b.start, "right")
    n = np.searchsorted(ends, b.end, "right") - first
    tail = (b.end > b.start) & ~solid[np.maximum(b.end - 1, 0)]
    return ends, first, n + tail


def _cut_at(b: Bytes, ends: np.ndarray, first: np.ndarray, n: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Byte place after ``unit`` units of each row."""
    inside = ends[np.clip(first + unit - 1, 0, max(len(ends) - 1, 0))] if len(ends) else b.start
    return np.where(unit == 0, b.start, np.where(unit == n, b.end, inside))


def _slice_rows(b: Bytes, h1: np.ndarray, h2: np.ndarray, plain: np.ndarray, spm: np.ndarray, by: str) -> dict:
    index = CharIndex(b.data)
    if by == "char":
        low = index.chars(b.start)
        n = index.chars(b.end) - low
    else:
        ends, first, n = word_cuts(b)
    one, two = h1 % (n + 1), h2 % (n + 1)
    lo, hi = np.minimum(one, two), np.maximum(one, two)
    if by == "char":
        a, z = index.bytes(low + lo), index.bytes(low + hi)
    else:
        a, z = (_cut_at(b, ends, first, n, u) for u in (lo, hi))
    start, a_chars, z_chars = index.chars(b.start), index.chars(a), index.chars(z)
    raw = b.data.tobytes()
    out = []
    for s, x, y, e, is_plain, suffix_first in zip(b.start.tolist(), a.tolist(), z.tolist(), b.end.tolist(), plain.tolist(), spm.tolist(), strict=True):
        if is_plain:
            out.append(raw[s:e])
        elif suffix_first:
            out.append(b"".join((SUF, raw[y:e], PRE, raw[s:x], MID, raw[x:y])))
        else:
            out.append(b"".join((PRE, raw[s:x], SUF, raw[y:e], MID, raw[x:y])))
    return {"n": pa.array(n, pa.int64()), "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
            "prefix_chars": pa.array(a_chars - start, pa.int64(), mask=plain), "middle_chars": pa.array(z_chars - a_chars, pa.int64(), mask=plain),
            "output": pa.array(out, pa.binary()).cast(pa.string())}


def transform(documents: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, by: str = "word", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, n (units), form, prefix_chars, middle_chars (null if
    plain) and output of every document. ``by``: cuts between words or chars."""
    if by not in ("word", "char"):
        raise ValueError(f"cuts lie between words or chars, not {by}")
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    group = lambda k: F.conv(F.substring("_hash", 8 * k + 1, 8), 16, 10).cast("long")
    marked = reduce(or_, (F.contains(F.col("_text"), F.lit(m.decode())) for m in (PRE, SUF, MID)))
    rows = documents.select("doc_id", *keep, text.alias("_text"), digest.alias("_hash")).select(
        "doc_id", *keep, "_text", group(0).alias("_h1"), group(1).alias("_h2"),
        ((F.col("_text") == "") | marked | (group(2) % 100 >= rate)).alias("_plain"), (group(3) % 100 < spm).alias("_spm"))
    kept = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch["_h1"].to_numpy(), batch["_h2"].to_numpy())
            plain, first = (batch[c].to_numpy(zero_copy_only=False) for c in ("_plain", "_spm"))
            for b in slices(batch["_text"]):
                at = slice(b.lo, b.hi)
                made = _slice_rows(b, h1[at], h2[at], plain[at], first[at], by)
                through = [batch.column(k).slice(b.lo, b.hi - b.lo) for k in range(kept)]
                yield pa.RecordBatch.from_arrays(through + list(made.values()), names=batch.schema.names[:kept] + list(made))

    schema = rows.select("doc_id", *keep).schema
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output. A text that was transformed holds no
    sentinel, and no two sentinels overlap, so the first three are the marks."""
    part = F.split(output, "<[PSM]>", 4)
    prefix, suffix = (F.when(form == "spm", part[b]).otherwise(part[a]) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))
