"""Benchmark decontamination by CGK embedding and bit-sampling LSH (op 2).

A document is contaminated by an item if somewhere in its text the item occurs
with a word edit distance of at most a fifth of the item's words (similarity
``SIMILAR``; words are runs of non-space characters, A-Z lower-cased).

1. *Which windows.* An occurrence with k edits leaves one of k + 1 equal pieces
   of the item intact. One pass over the whole texts looks every word n-gram up
   in a bitmap of fixed size that holds these pieces; hits, with the words
   around them, are joined with the pieces and give the item-sized windows that
   can match at all. This loses nothing.
2. *CGK.* Each window walks through its words by random bits; the walk's output
   turns edit distance into Hamming distance. In each of ``REPEATS`` repetitions
   ``samples_of(n)`` positions of the output make the key. Items get keys
   likewise. Windows start at the position that the piece implies and at steps
   around it, and only their keys that a bitmap of the items' keys may hold go on.
   The LSH join of the keys gives candidates. Recall aimed at is 0.99
   at a fifth of edits, so longer items have fewer positions in a key.
3. *Exact check*: the item is aligned with the surroundings of the window, if
   these hold enough of its words. Items under five words allow no edit, so they
   match exact copies only.

Defined results: null and empty texts are clean; items without a word, or with
null text, match nothing; repeated items are reported each; rows
are judged by id and text, so repeated rows get equal results; null ids are
ordinary; further columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import saved
from tidemark.llm.text import mix, slices, words

SIMILAR = 80          # hundredths of the item's words
MIN_WORDS = 1
REPEATS = 64
SHIFTS = 7            # starts tried around the implied one
BITMAP = 1 << 24      # bits of the piece filter
WINDOWS = 1024        # windows that are embedded at once
SEED = 271828

_PLACE = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def allowed(n: int, similar: int = SIMILAR) -> int:
    """Edits that an item of n words may have."""
    return n * (100 - similar) // 100


def gram(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out += h[k:len(h) - size + 1 + k] * _PLACE[k % 64]
        out = mix(out) if k % 64 == 63 else out
    return mix(out)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for b in slices(pa.array(texts, pa.large_string())):
        w = words(b)
        out += [w.hash[x:y] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def pieces_of(h: np.ndarray, similar: int = SIMILAR) -> list[tuple[int, int]]:
    """(offset, words) of the pieces of which an occurrence leaves one intact."""
    k = allowed(len(h), similar)
    size = len(h) // (k + 1)
    return [(j * size, size) for j in range(k + 1)]


def samples_of(n: int) -> int:
    """Outputs of the walk in a key of an item of n words."""
    return 2 if n <= 100 else 1


def cgk_keys(windows: np.ndarray, n: int) -> np.ndarray:
    """(rows, REPEATS) keys of windows of n words each. The walk of a repetition
    is decided by a hash of the current word and the step, so equal words move
    equally; it is sampled at ``samples_of(n)`` of its first 2n outputs."""
    rows = np.arange(len(windows))
    rng = np.random.default_rng([SEED, n])
    out = np.empty((len(windows), REPEATS), np.int64)
    padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], 1)
    for r in range(REPEATS):
        steps = np.sort(rng.choice(2 * n, samples_of(n), replace=False))
        salt = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at = np.zeros(len(windows), np.int64)
        key = np.full(len(windows), r * 4096 + n, np.uint64)
        for j in range(steps[-1] + 1):
            x = padded[rows, at]
            if j in steps:
                key = mix(key + x * _PLACE[j % 64])
            move = ((x * salt[j]) >> np.uint64(63)).astype(np.int64)
            at = np.minimum(at + move, n)
        out[:, r] = key.view(np.int64)
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Smallest word edit distance of ``item`` to any part of ``text``."""
    width = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != x), out=new[1:])
        row = np.minimum.accumulate(new - width) + width
    return int(row.min())


def items_of(benchmark: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(item_id, n, hashes, ih): usable items with their word hashes and a hash of these."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = word_hashes([t or "" for t in pdf["text"]])
            out = pd.DataFrame({"item_id": pdf["item_id"].astype("Int64"), "n": [len(x) for x in h], "hashes": [x.tobytes() for x in h]})
            yield out[out["n"] >= MIN_WORDS]

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return source.mapInPandas(run, "item_id long, n int, hashes binary").withColumn("ih", F.xxhash64("hashes"))


def seeds_of(items: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(gram, size, at, n, ih): the pieces of the items."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, ih in zip(pdf["hashes"], pdf["ih"], strict=True):
                h = np.frombuffer(raw, np.uint64)
                out += [(int(gram(h[o:o + size], size).view(np.int64)[0]), size, o, len(h), ih) for o, size in pieces_of(h, similar)]
            yield pd.DataFrame(out, columns=["gram", "size", "at", "n", "ih"])

    return items.mapInPandas(run, "gram long, size int, at int, n int, ih long").distinct()


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, list[int], int]:
    """Bitmap of the pieces, their sizes, and how far an occurrence can reach
    from a hit. The bitmap has ``BITMAP`` bits however many items there are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes: dict[int, np.ndarray] = {}
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                bits = sizes.setdefault(int(size), np.zeros(BITMAP, bool))
                bits[part["gram"].to_numpy().view(np.uint64) % np.uint64(BITMAP)] = True
        yield pd.DataFrame({"size": list(sizes), "bits": [zlib.compress(np.packbits(b)) for b in sizes.values()]})

    # each partition sends at most a bitmap per size of piece, and one partition is read at a time
    bits = np.zeros(BITMAP, bool)
    sizes: set[int] = set()
    for r in seeds.mapInPandas(run, "size int, bits binary").toLocalIterator():
        sizes.add(r["size"])
        bits |= np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8)).astype(bool)
    reach = seeds.agg(F.max("n")).head()[0] or 0
    return np.packbits(bits), sorted(sizes), int(reach + 2 * allowed(reach) + 1)


def regions(documents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, th, base, hashes, hits array<struct<at, gram>>): stretches of
    words around the hits of each whole text; ``at`` counts from ``base``."""
    bits, sizes, reach = _bitmap(seeds)
    shared = documents.sparkSession.sparkContext.broadcast(bits)   # BITMAP / 8 bytes
    hit_type = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for b in slices(batch.column("text")):
                w = words(b)
                found = []
                for size in sizes:
                    g = gram(w.hash, size)
                    p = np.flatnonzero(known[g % np.uint64(BITMAP)])
                    doc = np.searchsorted(w.first, p, "right") - 1
                    inside = p + size <= w.first[doc + 1]
                    found.append(np.stack([p[inside], g[p[inside]].view(np.int64), doc[inside]], 1))
                hits = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                hits = hits[np.argsort(hits[:, 0], kind="stable")]
                rows, base, hashes, lists = [], [], [], []
                cut = np.flatnonzero((np.diff(hits[:, 0]) > 2 * reach) | (np.diff(hits[:, 2]) > 0)) + 1
                for part in np.split(hits, cut) if len(hits) else []:
                    d = int(part[0, 2])
                    lo = max(int(w.first[d]), int(part[0, 0]) - reach)
                    hi = min(int(w.first[d + 1]), int(part[-1, 0]) + reach)
                    rows.append(d + b.lo)
                    base.append(lo - int(w.first[d]))
                    hashes.append(w.hash[lo:hi].tobytes())
                    lists.append([{"at": int(p) - lo, "gram": int(g)} for p, g in part[:, :2]])
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(base, pa.int64()),
                                                  pa.array(hashes, pa.binary()), pa.array(lists, hit_type)], ["doc_id", "th", "base", "hashes", "hits"])

    return documents.select("doc_id", "th", "text").mapInArrow(
        run, "doc_id long, th long, base long, hashes binary, hits array<struct<at:int,gram:bigint>>")


def shifts(k: int) -> list[int]:
    """Starts around the implied one: at most ``SHIFTS`` between -k and k."""
    return sorted({round(x) for x in np.linspace(-k, k, SHIFTS)} | {0})


def matches(documents: DataFrame, benchmark: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, th, item_id): items that occur in the texts of ``documents``
    (doc_id, th, text)."""
    items = saved(items_of(benchmark, similar), "items")
    seeds = saved(seeds_of(items, similar), "seeds")
    found = saved(regions(documents, seeds), "regions")
    row = ["doc_id", "th", "base"]
    near = hashed(found, items, seeds, similar).groupBy(*row, "ih").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    texts = items.select("ih", "n", "hashes").dropDuplicates(["ih"])
    pairs = near.join(texts.withColumnRenamed("hashes", "item"), "ih")
    pairs = pairs.select(*(F.col(c).alias(f"_{c}") for c in row), "ih", "lo", "hi", "n", "item")
    pairs = found.select(*row, "hashes").join(pairs, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")) & (F.col("base") == F.col("_base")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for r in pdf.itertuples(index=False):
                h, item = np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.item, np.uint64)
                k = allowed(r.n, similar)
                part = h[max(0, r.lo - 2 * k):r.hi + r.n + 2 * k]
                good.append(np.isin(item, part).sum() >= r.n - k and edit_distance(item, part) <= k)
            yield pdf.loc[good, ["doc_id", "th", "ih"]]

    good = pairs.select(*row, "hashes", "ih", "lo", "hi", "n", "item").mapInPandas(verify, "doc_id long, th long, ih long").distinct()
    return good.join(items.select("ih", "item_id"), "ih").select("doc_id", "th", "item_id").distinct()


def hashed(found: DataFrame, items: DataFrame, seeds: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, th, base, ih, lo, hi): windows of the regions ``found`` that agree
    with an item in a key, by the first and the last start."""
    row = ["doc_id", "th", "base"]

    def embed_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby("n"):
                keys = cgk_keys(np.stack([np.frombuffer(x, np.uint64) for x in part["hashes"]]), int(n))
                yield pd.DataFrame({"ih": np.repeat(part["ih"].to_numpy(), REPEATS), "n": n, "key": keys.reshape(-1)})

    texts = items.select("ih", "n", "hashes").dropDuplicates(["ih"])
    item_keys = saved(texts.mapInPandas(embed_items, "ih long, n long, key long"), "item-keys")
    bits, _, _ = _bitmap(item_keys.select(F.col("key").alias("gram"), F.lit(0).alias("size"), "n"))
    shared = found.sparkSession.sparkContext.broadcast(bits)   # BITMAP / 8 bytes
    hits = found.select(*row, F.explode("hits").alias("hit")).select(*row, "hit.at", "hit.gram")
    implied = seeds.select("gram", F.col("at").alias("offset"), "n").distinct()
    starts = hits.join(implied, "gram").select(*row, (F.col("at") - F.col("offset")).alias("start"), "n").distinct()
    lists = starts.groupBy(*row).agg(F.collect_list(F.struct("start", "n")).alias("windows"))

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(shared.value).astype(bool)
        for pdf in batches:
            groups: dict[int, list[tuple[int, int, np.ndarray]]] = {}
            for i, (raw, windows) in enumerate(zip(pdf["hashes"], pdf["windows"], strict=True)):
                h = np.frombuffer(raw, np.uint64)
                for n in {w["n"] for w in windows}:
                    tried = {w["start"] + d for w in windows if w["n"] == n for d in shifts(allowed(n, similar))}
                    for s in tried:
                        if 0 <= s < len(h):
                            part = np.zeros(n, np.uint64)
                            part[:len(h[s:s + n])] = h[s:s + n]
                            groups.setdefault(n, []).append((i, s, part))
            for n, rows in groups.items():
                for part in (rows[lo:lo + WINDOWS] for lo in range(0, len(rows), WINDOWS)):
                    keys = cgk_keys(np.stack([r[2] for r in part]), n).reshape(-1)
                    may = known[keys.view(np.uint64) % np.uint64(BITMAP)]
                    out = pd.DataFrame({"at": np.repeat([r[0] for r in part], REPEATS)[may], "key": keys[may], "start": np.repeat([r[1] for r in part], REPEATS)[may]})
                    out = out.groupby(["at", "key"])["start"].agg(["min", "max"]).reset_index()
                    yield pdf.iloc[out["at"]][row].assign(lo=out["min"].to_numpy(), hi=out["max"].to_numpy(), n=n, key=out["key"].to_numpy())

    cut = found.join(lists.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("base").alias("_b"), "windows"),
                     F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("base") == F.col("_b")))
    keys = cut.select(*row, "hashes", "windows").mapInPandas(embed, "doc_id long, th long, base long, lo long, hi long, n long, key long")
    return keys.join(item_keys, ["key", "n"]).select(*row, "ih", "lo", "hi")


def decontaminate(documents: DataFrame, benchmark: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row per row of ``documents``: doc_id, th (hash of the text),
    contaminated, n_items and item_ids (ascending)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    found = matches(docs, benchmark, similar).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = saved(found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "item_ids"), "contaminated")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    return docs.select("doc_id", "th").join(found, on, "left").select(
        "doc_id", "th", F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))
