"""Removal of long repeated substrings with a run-length index (op 3).

Texts are byte strings. A byte goes if it is covered by a ``LENGTH``-byte string
that also starts anywhere else in the corpus (overlaps count; strings are judged
on the input; matches never cross documents).

1. *Routing.* Every ``LENGTH``-byte window has an anchor: the ``ANCHOR``-byte
   string in it with the smallest hash (leftmost among equals). Equal windows
   have equal anchors, so windows need comparing only under the same anchor.
   Consecutive windows with one anchor form a segment; each window of the corpus
   lies in exactly one segment. Anchors that occur once need nothing further.
2. Segments that are equal as a whole are all repeats; one of them represents
   the others below.
3. *Index.* The other segments with a repeated anchor are fetched and, anchor by
   anchor, concatenated in bounded batches. A batch gets its suffix order, the
   run-length Burrows-Wheeler transform, and samples at the ends of its runs:
   there the common prefix with the neighbouring suffix is measured. Between
   samples it falls by one per position, so matching statistics against the rest
   of the batch stream along the text from the samples alone. Positions whose
   statistic reaches ``LENGTH`` are marked.
4. *Hot anchors* (above ``GROUP`` different segments, such as the rims of a
   passage that a third of the documents share) must not meet in one task. Their
   segments are cut on a grid of offsets from the anchor; equal cuts are repeats,
   cuts whose common core is unique are not, and the rest is cut finer, down to
   single windows, with counts by partial aggregation. This is exact as well.

Defined results: null and empty texts have no bytes; texts below ``LENGTH``
bytes lose nothing; rows that repeat id and text are copies of each other; null
ids are ordinary; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import saved
from tidemark.llm.text import Bytes, prefix_hash, slices, span_hash

LENGTH = 200
ANCHOR = 64
GROUP = 256               # segments of an anchor that one batch may hold together
BATCH_BYTES = 1 << 17     # text of a batch, about; its arrays stay in the cache
BROADCAST_ROWS = 1 << 20  # repeated anchors that are broadcast (8 MB of keys); more are joined by shuffle
GRID = (64, 16, 4, 1)
WORD = 7                  # symbols of nine bits in a 64-bit word
SLICE = 1 << 16            # text scanned at a time; likewise
PIECE = 8 << 20           # longer texts are scanned in overlapping pieces


# ---- routing

def segments(b: Bytes, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Segments of a slice: row, start (in the row), windows, at (of the anchor,
    from the start), key (anchor hash) and body (hash of all its bytes)."""
    data, n = b.data, len(b.data)
    span = length - anchor + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return {"row": none, "start": none, "windows": none, "at": none, "key": none, "body": none}
    c = prefix_hash(data)
    pos = np.arange(n - anchor + 1)
    g = span_hash(c, pos, pos + anchor)
    # 40 bits of the hash, then the position: the minimum is the leftmost of the smallest
    low = (g & np.uint64(0xFFFFFFFFFF000000)) | pos.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)   # anchor of the window that starts here
    size = b.end - b.start
    rows = np.flatnonzero(size >= length)
    many = size[rows] - length + 1
    row = np.repeat(rows, many)
    s = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + b.start[row]
    m = at[s]
    new = np.ones(len(s), bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return {"row": none, "start": none, "windows": none, "at": none, "key": none, "body": none}
    last = np.append(first[1:], len(s)) - 1
    begin, end = s[first], s[last] + length
    return {"row": row[first], "start": begin - b.start[row[first]], "windows": last - first + 1, "at": m[first] - begin,
            "key": g[m[first]].view(np.int64), "body": span_hash(c, begin, end).view(np.int64)}


def _pieces(b: Bytes, length: int) -> Iterator[tuple[Bytes, int]]:
    """A slice, or overlapping pieces of a very long row that hold each window once."""
    if len(b.data) <= PIECE:
        yield b, 0
        return
    for at in range(0, len(b.data) - length + 1, PIECE):
        part = b.data[at:at + PIECE + length - 1]
        yield Bytes(b.lo, b.hi, part, np.zeros(1, np.int64), np.array([len(part)])), at


def scan(documents: DataFrame, length: int, anchor: int, only_keys: bool = False) -> DataFrame:
    """Segments of all rows of ``documents`` (doc_id, th, text)."""
    names = ["start", "windows", "at", "key", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch.column("text"), SLICE):
                for part, shift in _pieces(b, length):
                    s = segments(part, length, anchor)
                    if only_keys:
                        key, many = np.unique(s["key"], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.minimum(many, 2).astype(np.int32))], ["key", "n"])
                        continue
                    rows = pa.array(s["row"] + b.lo)
                    s["start"] = s["start"] + shift
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows),
                                                      *(pa.array(s[k].astype(np.int64)) for k in names)], ["doc_id", "th", *names])

    shape = "key long, n int" if only_keys else "doc_id long, th long, start long, windows long, at long, key long, body long"
    return documents.select("doc_id", "th", "text").mapInArrow(run, shape)


# ---- run-length index

class RunIndex:
    """Run-length Burrows-Wheeler transform of a batch of strings, each closed by
    its own terminator, with samples at the run ends."""

    def __init__(self, strings: list[bytes]):
        self.first = np.cumsum([0] + [len(s) + 1 for s in strings])
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        n = self.n = len(text)
        stop = np.zeros(n, bool)
        stop[self.first[1:] - 1] = True
        self.text, self.stop = text, stop
        self.levels: list[tuple[int, np.ndarray]] = []
        self.order = self._suffix_order(int(np.diff(self.first).max()))
        before = np.concatenate([[n - 1], np.arange(n - 1)])[self.order]
        char = np.where(stop[before], -1 - before, text[before].astype(np.int64))   # terminators all differ
        self.head = np.ones(n, bool)
        self.head[1:] = char[1:] != char[:-1]
        self.runs = int(self.head.sum())

    def _suffix_order(self, longest: int) -> np.ndarray:
        """Prefix doubling from words of seven symbols; ranks are kept for
        comparisons. A terminator is below every byte, and terminators are in
        the order of the strings."""
        n = self.n
        pad = np.concatenate([np.where(self.stop, 0, self.text.astype(np.uint64) + 1), np.zeros(WORD, np.uint64)]).astype(np.uint64)
        word = np.zeros(n, np.uint64)
        ended = np.zeros(n, bool)    # the word has met the terminator
        gone = np.concatenate([self.stop, np.ones(WORD, bool)])
        for k in range(WORD):
            word = (word << np.uint64(9)) | np.where(ended, np.uint64(0), pad[k:k + n])
            ended |= gone[k:k + n]
        order = np.argsort(word, kind="stable")
        w, e = word[order], ended[order]
        fresh = np.ones(n + 1, bool)    # a new rank begins; what has met its terminator stands alone
        fresh[1:n] = (w[1:] != w[:-1]) | e[1:] | e[:-1]
        places = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh[:n], places, 0))
        width = WORD
        self.levels.append((width, rank.copy()))
        while width < longest:
            tied = np.flatnonzero(~(fresh[:n] & fresh[1:]))    # only ranks of several suffixes are sorted on
            if not len(tied):
                break
            at = order[tied]
            key = rank[at] * np.int64(n) + rank[np.minimum(at + width, n - 1)]
            new = np.argsort(key)
            key = key[new]
            order[tied] = at[new]
            fresh[tied[1:]] |= key[1:] != key[:-1]
            rank[order[tied]] = np.maximum.accumulate(np.where(fresh[:n], places, 0))[tied]
            width *= 2
            self.levels.append((width, rank.copy()))
        return order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b (a != b)."""
        got = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            x, y = np.minimum(a + got, self.n - 1), np.minimum(b + got, self.n - 1)
            got += np.where(rank[x] == rank[y], width, 0)
        live = np.ones(len(a), bool)
        for _ in range(WORD - 1):
            x, y = np.minimum(a + got, self.n - 1), np.minimum(b + got, self.n - 1)
            live &= (self.text[x] == self.text[y]) & ~self.stop[x] & ~self.stop[y]
            got += live
        return got

    def statistics(self) -> np.ndarray:
        """For each position the length of the longest match that starts there
        and also elsewhere: samples at run ends, streamed along the text."""
        n, order = self.n, self.order
        best = np.zeros(n, np.int64)
        tail = np.append(self.head[1:], True)
        for sampled, step in ((self.head, -1), (tail, 1)):
            i = np.flatnonzero(sampled)
            j = i + step
            ok = (j >= 0) & (j < n)
            value = np.zeros(len(i), np.int64)
            value[ok] = self.common(order[i[ok]], order[j[ok]])
            known = np.full(n, -1, np.int64)
            known[order[i]] = value
            at = np.maximum.accumulate(np.where(known >= 0, np.arange(n), -1))
            best = np.maximum(best, known[at] - (np.arange(n) - at))
        return best


def mark_batch(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string the offsets of its windows that occur more than once."""
    index = RunIndex(strings)
    hit = index.statistics() >= length
    return [np.flatnonzero(hit[a:b]) for a, b in zip(index.first[:-1], index.first[1:], strict=True)]


def _intervals(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes from sorted window starts."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


SPAN = "doc_id long, th long, lo long, hi long"


def _spans(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "th", "lo", "hi"])
    return out.astype({"doc_id": "Int64", "th": "int64", "lo": "int64", "hi": "int64"})


def index_segments(segs: DataFrame, length: int) -> DataFrame:
    """Repeated spans found by run-length indexes over whole anchor groups.
    ``segs``: key, doc_id, th, start, open, data."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, now = 0, None

        def flush() -> pd.DataFrame:
            out = []
            for row, hits in zip(held, mark_batch([r.data for r in held], length), strict=True):
                if row.open and len(hits):
                    out += [(row.doc_id, row.th, row.start + int(a), row.start + int(z)) for a, z in zip(*_intervals(hits, length), strict=True)]
            return _spans(out)

        for pdf in batches:
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            for row in pdf.itertuples(index=False):
                if row.key != now and size >= BATCH_BYTES:
                    yield flush()
                    held, size = [], 0
                now = row.key
                held.append(row)
                size += len(row.data) + 1
        if held:
            yield flush()

    return segs.repartition("key").sortWithinPartitions("key").mapInPandas(run, SPAN)


# ---- hot anchors

def _cuts(key: int, at: int, lo: int, hi: int, data: bytes, grid: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts of the windows lo..hi-1 of a segment on a grid of offsets from its
    anchor: (first window, end, hash of all bytes, hash of the core)."""
    c = prefix_hash(np.frombuffer(data, np.uint8))
    cuts = []
    s = lo
    while s < hi:
        block = (at - s) // grid
        end = min(hi, at - block * grid + 1)     # windows s..end-1 have offsets in this block
        core_lo, core_hi = at - block * grid, at - (block * grid + grid - 1) + length
        cuts.append((s, end, core_lo, core_hi, block))
        s = end
    a = np.array(cuts, np.int64)
    salt = np.uint64((key ^ grid * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    offset = ((at - a[:, 0]) * 4096 + (at - a[:, 1])).astype(np.uint64)
    whole = span_hash(c, a[:, 0], a[:, 1] - 1 + length) ^ salt ^ (offset * np.uint64(0xD6E8FEB86659FD93))
    core = span_hash(c, a[:, 2], a[:, 3]) ^ salt ^ (a[:, 4].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) ^ np.uint64(1)
    yield from zip(a[:, 0].tolist(), a[:, 1].tolist(), whole.view(np.int64).tolist(), core.view(np.int64).tolist(), strict=True)


def refine(segs: DataFrame, length: int) -> list[DataFrame]:
    """Repeated spans of segments whose anchor is hot; columns as in
    :func:`index_segments`, and ``at`` and ``windows``. ``open`` segments are
    judged; the others stand for equal ones."""
    rows = segs.select("key", "doc_id", "th", "start", "at", "open", "data", F.lit(0).cast("long").alias("lo"), F.col("windows").alias("hi"))
    shape = "key long, doc_id long, th long, start long, at long, open boolean, data binary, lo long, hi long, whole long, core long"
    found = []
    for grid in (g for g in GRID if 2 * g <= length or g == 1):    # a cut has a core only below the length
        def cut(batches: Iterator[pd.DataFrame], grid: int = grid) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["doc_id"] = pdf["doc_id"].astype("Int64")
                parts = [(i, *x) for i, r in enumerate(pdf.itertuples(index=False)) for x in _cuts(r.key, r.at, r.lo, r.hi, r.data, grid, length)]
                at, lo, hi, whole, core = (list(x) for x in zip(*parts, strict=True)) if parts else ([], [], [], [], [])
                yield pdf.iloc[at].assign(lo=lo, hi=hi, whole=whole, core=core).astype({k: "int64" for k in ("lo", "hi", "whole", "core")})

        cuts = saved(rows.mapInPandas(cut, shape), f"cuts-{grid}")
        often = cuts.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("whole", F.lit(True).alias("repeated"))
        judged = cuts.join(often, "whole", "left")
        found.append(judged.where("repeated and open").select("doc_id", "th", (F.col("start") + F.col("lo")).alias("lo"),
                                                              (F.col("start") + F.col("hi") - 1 + length).alias("hi")))
        if grid > 1:
            # one row per distinct cut goes on if it may share a window with another cut
            distinct = cuts.groupBy("whole").agg(F.first("core").alias("core")).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            shared = judged.join(distinct.select("core"), "core", "left_semi")
            unique = shared.where("repeated is null")
            stand_in = (shared.where("repeated").groupBy("whole").agg(F.min(F.struct(
                "key", "doc_id", "th", "start", "at", "data", "lo", "hi")).alias("s")).select("s.*").withColumn("open", F.lit(False)))
            names = ["key", "doc_id", "th", "start", "at", "open", "data", "lo", "hi"]
            rows = saved(unique.select(*names).unionByName(stand_in.select(*names)), f"open-{grid}")
    return found


# ---- the operator

def _fetch(documents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` segments with their bytes in ``data``."""
    names = ["start", "windows", "at", "key", "open", "hot"]
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*names)).alias("segs"))
    on = lists["doc_id"].eqNullSafe(documents["doc_id"]) & (lists["th"] == documents["th"])
    # rows that repeat id and text would fetch a segment more than once
    joined = documents.join(lists, on).select(documents["doc_id"], documents["th"], "text", "segs").dropDuplicates(["doc_id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segs = batch.column("segs")
            flat = segs.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.asarray(segs.value_lengths()))
            start, windows = (flat.field(k).to_numpy() for k in ("start", "windows"))
            data: list[bytes] = []
            last, raw = -1, b""
            for r, s, w in zip(row.tolist(), start.tolist(), windows.tolist(), strict=True):
                if r != last:
                    last, raw = r, batch.column("text")[r].as_py().encode()
                data.append(raw[s:s + w - 1 + length])
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows),
                                              *(flat.field(k) for k in names), pa.array(data, pa.binary())], ["doc_id", "th", *names, "data"])

    return joined.mapInArrow(run, "doc_id long, th long, start long, windows long, at long, key long, open boolean, hot boolean, data binary")


def repeated_spans(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, th, lo, hi): byte ranges that go; they may overlap."""
    keys = scan(documents, length, anchor, only_keys=True).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    keys = saved(keys, "anchors")
    few = keys.count() <= BROADCAST_ROWS
    segs = saved(scan(documents, length, anchor).join(F.broadcast(keys) if few else keys, "key", "left_semi"), "segments")
    bodies = saved(segs.groupBy("key", "body").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "start", "windows", "at")).alias("one")), "bodies")
    sizes = bodies.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    # equal segments: all windows are repeats
    equal = (segs.join(bodies.where("n > 1").select("key", "body"), ["key", "body"], "left_semi")
             .select("doc_id", "th", F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1 + length).alias("hi")))
    # anchors with several kinds of segments: one of each kind is compared
    wanted = (bodies.join(sizes.where("kinds > 1"), "key")
              .select("key", "one.*", (F.col("n") == 1).alias("open"), (F.col("kinds") > GROUP).alias("hot")))
    fetched = saved(_fetch(documents, wanted, length), "fetched")
    spans = equal.unionByName(index_segments(fetched.where("not hot").select("key", "doc_id", "th", "start", "open", "data"), length))
    for part in refine(fetched.where("hot"), length):
        spans = spans.unionByName(part)
    return spans


def remove_repeats(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans,
    kept (the remaining bytes)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(docs, length, anchor)
    lists = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans")
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch.column("text")):
                lists = batch.column("spans").slice(b.lo, b.hi - b.lo)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(b.start)), np.asarray(lists.value_lengths().fill_null(0)))
                mark = np.zeros(len(b.data) + 1, np.int64)
                np.add.at(mark, b.start[row] + flat.field("lo").to_numpy(), 1)
                np.add.at(mark, b.start[row] + flat.field("hi").to_numpy(), -1)
                gone = np.cumsum(mark)[:-1] > 0
                kept = b.data[~gone].tobytes()
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[b.end] - total[b.start]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                firsts = b.start[b.start < b.end]
                begins[firsts] = gone[firsts]
                runs = np.concatenate([[0], np.cumsum(begins)])
                size = b.end - b.start
                ends = np.concatenate([[0], np.cumsum(size - removed)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.lo, b.hi - b.lo), pa.array(size), pa.array(removed), pa.array(runs[b.end] - runs[b.start]),
                     pa.array([kept[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
