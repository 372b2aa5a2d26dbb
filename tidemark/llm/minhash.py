"""Near-duplicate documents by b-bit MinHash (op 7).

A document's set holds its distinct five-word shingles (A-Z lower-cased; the
whole sequence when it has fewer words). Two documents are linked if the
Jaccard similarity of their full sets reaches ``LINK`` hundredths; a group is a
connected component of links, and its smallest ``doc_id`` stays.

1. One pass hashes the words and takes ``HASHES`` minima per document. Only the
   low two bits of each minimum are kept, packed into four longs; ``BANDS``
   keys of ``ROWS`` whole minima are made on the way.
2. Equal sets are one class, represented by the smallest ``doc_id``.
3. Classes that share a band key are candidates. The similarity of a pair is
   estimated from the number of equal two-bit values, corrected for the quarter
   that agree by chance; far pairs are dropped before any text is touched.
4. Remaining pairs are confirmed on the full sets.

No bucket is expanded into all its pairs. First each bucket proposes a few
pairs per member: with the bucket's pivot, and with neighbours in random orders
(dealt into small sub-buckets); confirmed links merge members into components. Only buckets that then still hold several components compare
members, across components, in a join whose condition is an estimate from a
longer signature (``FINE`` hashes, made for those members only). So a group of
thousands of copies costs a number of pairs in proportion to its size, and no
link between components is left out.

A pair at the link threshold shares a band with probability 1 - 4e-7 and passes
either estimate with probability above 1 - 1e-7.

Defined results: null, empty and blank texts have an empty set, link with
nothing and stay; rows with a null ``doc_id`` likewise; rows that repeat a
``doc_id`` are one node, linked by the text of any of them; further columns are
ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import saved
from tidemark.llm.text import Bytes, Words, mix, slices, words
from tidemark.operators.components import connected_components

SHINGLE = 5
HASHES = 128
BITS = 2
BANDS, ROWS = 25, 5
LINK = 85             # hundredths
ESTIMATE = 0.65       # pairs estimated below are not confirmed; 5.5 standard deviations under LINK
FINE = 1024
FINE_ESTIMATE = 0.777  # likewise for the long signature
CHAINS = 3
CHAIN_ROWS = 256      # members of a sub-bucket, about

_RNG = np.random.default_rng(715517)
_ORDER = _RNG.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 32, HASHES + FINE, dtype=np.uint32)
_MULT = _RNG.integers(0, 1 << 31, HASHES + FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of a slice (with repeats), and for each row
    the index of its first one; one more entry at the end."""
    n = np.diff(w.first)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(n)), many)
    at = np.arange(first[-1]) - first[doc] + w.first[doc]
    length = np.minimum(n[doc], SHINGLE)
    h = length.astype(np.uint64) * _ORDER[SHINGLE]
    last = len(w.hash) - 1
    for k in range(SHINGLE):
        part = w.hash[np.minimum(at + k, last)] * _ORDER[k] if len(at) else h
        h += np.where(k < length, part, np.uint64(0))
    return mix(h), first


def minima(h: np.ndarray, first: np.ndarray, hashes: range = range(HASHES)) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their (rows, hashes) 32-bit minima."""
    rows = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(rows), len(hashes)), np.uint32)
    if len(rows):
        low = (h >> np.uint64(32)).astype(np.uint32)
        work = np.empty_like(low)
        for at, k in enumerate(hashes):
            np.bitwise_xor(low, _FLIP[k], out=work)
            np.multiply(work, _MULT[k], out=work)
            out[:, at] = np.minimum.reduceat(work, first[rows])
    return rows, out


def pack(mins: np.ndarray) -> np.ndarray:
    """Low bits of the minima in longs, ``64 // BITS`` values each."""
    per = 64 // BITS
    low = (mins & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(mins), -1, per)
    return np.bitwise_or.reduce(low << (np.uint64(BITS) * np.arange(per, dtype=np.uint64)), axis=2).view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    v = mins[:, :BANDS * ROWS].reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    return mix((v * _BAND[:, :ROWS]).sum(2, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64)


def _sets(b: Bytes) -> list[np.ndarray]:
    h, first = shingles(words(b))
    return [np.unique(h[first[i]:first[i + 1]]) for i in range(len(first) - 1)]


def _lists(values: np.ndarray, has: np.ndarray) -> pa.Array:
    """The rows of ``values`` as lists for the rows that ``has`` marks, else empty lists."""
    ends = np.concatenate([[0], np.cumsum(np.where(has, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sig, bands) per row; hi and lo are a 128-bit
    digest of the set; sig and bands are empty for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch.column("text")):
                h, first = shingles(words(b))
                rows, mins = minima(h, first)
                count = np.zeros(len(b.start), np.int64)
                digest = []
                for i in rows:
                    u = np.unique(h[first[i]:first[i + 1]])
                    count[i] = len(u)
                    digest.append(xxhash.xxh3_128_digest(u.tobytes()))
                pair = np.zeros((len(b.start), 2), np.int64)
                pair[rows] = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                size = np.zeros(len(b.start), bool)
                size[rows] = True

                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.lo, b.hi - b.lo), pa.array(count), pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                     _lists(pack(mins), size), _lists(band_keys(mins), size)], ["doc_id", "n_shingles", "hi", "lo", "sig", "bands"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, sig array<bigint>, bands array<bigint>")


def fine_signatures(texts: DataFrame) -> DataFrame:
    """(rep, sig): long signatures of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch.column("text")):
                rows, mins = minima(*shingles(words(b)), range(HASHES, HASHES + FINE))
                ids = batch.column("doc_id").slice(b.lo, b.hi - b.lo).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, _lists(pack(mins), np.ones(len(rows), bool))], ["rep", "sig"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, sig array<bigint>")


def estimate(a: str, b: str, hashes: int = HASHES) -> Column:
    """Similarity from the number of equal values in two packed signatures,
    corrected for values that agree by chance."""
    mask = int("5" * 16, 16)

    def differing(x: Column) -> Column:
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(mask)))

    differ = F.lit(0)
    for k in range(hashes * BITS // 64):
        differ = differ + differing(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    chance = 1 / (1 << BITS)
    return (F.lit(1 - chance) - differ / F.lit(float(hashes))) / F.lit(1 - chance)


def _near(link: int, hashes: int = HASHES, least: float = ESTIMATE) -> Column:
    """Sizes and signatures that allow a link between rows with suffixes _a, _b."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * link
    return sizes & (estimate("sig_a", "sig_b", hashes) >= F.lit(least - (LINK - link) / 100))


def confirm(pairs: DataFrame, texts: DataFrame, link: int = LINK) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. ``texts``: (doc_id, text)."""
    with_a = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column("text_a"), batch.column("text_b")
            step = 64
            for lo in range(0, len(left), step):
                sets = [[s for b in slices(c.slice(lo, step)) for s in _sets(b)] for c in (left, right)]
                for x, y in zip(*sets, strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= link * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after merging the components that ``links`` (pairs of labels) join."""
    merged = connected_components(links, "a", "b").select(F.col("vertex").alias("label"), F.col("label").alias("to"))
    return labels.join(merged, "label", "left").select("rep", F.coalesce("to", "label").alias("label"))


def near_duplicates(documents: DataFrame, link: int = LINK) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id (the
    smallest doc_id of its group) and kept."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = saved(signatures(docs), "signatures")
    full = sigs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = saved(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    reps = saved(full.join(classes, ["hi", "lo"]).where(F.col("doc_id") == F.col("rep"))
                 .select("rep", F.col("n_shingles").alias("n"), "sig", "bands", "hi").dropDuplicates(["rep", "hi"]), "representatives")
    rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("one"), F.max("rep").alias("two")).where(F.col("one") < F.col("two"))
    buckets = saved(rows.join(shared.select("key"), "key", "left_semi"), "buckets")
    members = saved(buckets.select("rep").distinct(), "members")
    facts = saved(reps.join(members, "rep", "left_semi").select("rep", "n", "sig", "bands"), "facts")
    texts = saved(docs.join(members.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), "texts")
    side = lambda x: facts.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    def settle(pairs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """Labels after confirming ``pairs`` (a, b, la, lb)."""
        pairs = saved(pairs, f"{name}-pairs")
        links = confirm(pairs, texts, link).join(pairs, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        return saved(_relabel(labels, saved(links, f"{name}-links")), f"{name}-labels")

    # one pair per member: with the smallest of its bucket, and along chains in random orders
    sizes = buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size"))
    here = buckets.join(sizes, "key")
    pairs = here.select("rep", F.col("pivot").alias("other"))
    for k in range(1, CHAINS + 1):
        salt = F.pmod(F.xxhash64("rep", F.lit(-k)), F.ceil(F.col("size") / F.lit(CHAIN_ROWS)))
        chain = Window.partitionBy("key", "salt").orderBy(F.xxhash64("rep", F.lit(k)), "rep")
        pairs = pairs.unionByName(here.withColumn("salt", salt).select("rep", F.lead("rep").over(chain).alias("other")))
    pairs = pairs.where(F.col("rep") != F.col("other")).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(_near(link)).select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))
    labels = settle(pairs, members.select("rep", F.col("rep").alias("label")), "near")

    # all pairs of different components in the buckets that still hold several
    here = buckets.join(labels, "rep")
    mixed = here.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high")).select("key")
    live = saved(here.join(mixed, "key", "left_semi"), "live")
    left = live.select(F.col("rep").alias("doc_id")).distinct()
    fine = saved(fine_signatures(texts.join(left, "doc_id", "left_semi")).join(facts.select("rep", "n", "bands"), "rep"), "fine")
    wide = live.join(fine, "rep")
    one, two = (wide.select("key", F.col("rep").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("bands").alias(f"bands_{x}"))
                for x in "ab")
    apart = (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
    # a pair that shares several bands is made in one of them
    here_only = one["key"] == F.array_min(F.array_intersect("bands_a", "bands_b"))
    pairs = one.join(two, apart & _near(link, FINE, FINE_ESTIMATE) & here_only).select("a", "b", "la", "lb").distinct()
    labels = settle(pairs, labels, "last")
    groups = classes.join(labels, "rep", "left").select("hi", "lo", F.coalesce("label", "rep").alias("component_id"))
    slim = sigs.select("doc_id", "n_shingles", "hi", "lo")
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    placed = (slim.where(~empty).join(groups, ["hi", "lo"])
              .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))
    alone = slim.where(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return placed.unionByName(alone)
