"""Exact substring search (Q2) over stored trigram postings.

:func:`build_index` writes three tables below one path:

* ``postings`` (gram, id), partitioned by ``part`` (the gram's first character
  modulo the number of parts) and sorted by (gram, id) inside the files;
* ``grams`` (gram, n_docs), the dictionary, sorted by gram;
* ``texts`` (id, haystack), partitioned by ``block``, a hash bucket of the id.

A gram is three code points packed into one long (21 bits each, exact, no
hashing). Every character of a haystack starts one gram; the last two are
padded, so a term of one or two characters is a range of grams, a prefix of the
dictionary.

A search intersects by count: rows that hold every probed gram of the terms.
Terms of three or more characters probe their rarest grams by the dictionary
(fewer probes give more candidates, never other results); shorter ones probe
their range. Candidates are then verified on their whole haystacks, of which
only the blocks that hold candidates are read.

Hot grams: postings are dealt by part and rebalanced by size, so a part with a
gram that every row holds is split over as many tasks and files as its rows
fill, and a search counts it with partial aggregation.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.curation import bounded_broadcast
from tidemark.operators.query import search_match

PARTS = 64
BLOCK_ROWS = 100_000     # rows of a block of texts, about
MOST_BLOCKS = 4096
PROBES = 4               # grams probed per long term
BITS = 21


def pack(points: np.ndarray) -> np.ndarray:
    """Trigrams that start at each of ``points`` but the last two (code points
    plus one; zero is the padding)."""
    p = points.astype(np.int64)
    return (p[:-2] << 2 * BITS) | (p[1:-1] << BITS) | p[2:]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1


def text_grams(text: str) -> np.ndarray:
    """Distinct grams of a haystack, the padded ones at its end included."""
    return np.unique(pack(np.concatenate([_points(text), [0, 0]])))


def term_grams(term: str) -> list[int]:
    """Distinct grams of a term of three or more characters."""
    return np.unique(pack(_points(term))).tolist()


def term_range(term: str) -> tuple[int, int]:
    """First and last gram that start with a term of one or two characters."""
    p = _points(term).tolist()
    free = 3 - len(p)
    low = sum(c << BITS * (2 - k) for k, c in enumerate(p))
    return low, low + (1 << BITS * free) - 1


def part_of(gram: Column | int, parts: int):
    if isinstance(gram, int):
        return (gram >> 2 * BITS) % parts
    return (F.shiftright(gram, 2 * BITS) % parts).cast("int")


def block_of(row: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")


def _explode_grams(rows: DataFrame) -> DataFrame:
    """(id, gram) of (id, haystack)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                grams = [text_grams(t) if t else np.zeros(0, np.int64) for t in piece["haystack"].to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *grams])
                yield pa.RecordBatch.from_arrays([piece["id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "grams"])

    return rows.mapInArrow(run, "id long, grams array<long>").select("id", F.explode("grams").alias("gram"))


def build_index(rows: DataFrame, key: str, haystack: Column, path: str, parts: int = PARTS) -> SearchIndex:
    """Index ``haystack`` of all ``rows`` under their unique long ``key``."""
    spark = rows.sparkSession
    base = path.rstrip("/")
    texts = rows.select(F.col(key).cast("long").alias("id"), F.lower(F.coalesce(haystack, F.lit(""))).alias("haystack"))
    blocks = min(max(1, rows.count() // BLOCK_ROWS), MOST_BLOCKS)
    texts.withColumn("block", block_of(F.col("id"), blocks)).hint("rebalance", "block").write.partitionBy("block").parquet(f"{base}/texts")
    stored = spark.read.schema("id long, haystack string, block int").parquet(f"{base}/texts").select("id", "haystack")
    order = ["part", "gram", "id"]
    postings = _explode_grams(stored).withColumn("part", part_of(F.col("gram"), parts))
    postings.hint("rebalance", "part").sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{base}/postings")
    found = SearchIndex(spark, base, parts, blocks)
    grams = found.postings().groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{base}/grams")
    return found


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    parts: int
    blocks: int

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram long, id long, part int").parquet(f"{self.path}/postings")

    def grams(self) -> DataFrame:
        return self.spark.read.schema("gram long, n_docs long").parquet(f"{self.path}/grams")

    def texts(self) -> DataFrame:
        return self.spark.read.schema("id long, haystack string, block int").parquet(f"{self.path}/texts")

    def _none(self) -> DataFrame:
        return self.spark.range(0).select("id")

    def _probes(self, terms: list[str]) -> list[int] | None:
        """The rarest grams of every long term; None if a gram is nowhere. The
        driver sees one row per gram of the terms."""
        wanted = {t: term_grams(t) for t in terms}
        every = sorted({g for grams in wanted.values() for g in grams})
        known = {r["gram"]: r["n_docs"] for r in self.grams().where(F.col("gram").isin(every)).collect()}
        if len(known) < len(every):
            return None
        return sorted({g for grams in wanted.values() for g in sorted(grams, key=lambda g: (known[g], g))[:PROBES]})

    def candidates(self, terms: list[str]) -> DataFrame:
        """Ids of the rows that hold every probed gram of ``terms``."""
        terms = list(dict.fromkeys(terms))
        long, short = [t for t in terms if len(t) >= 3], [t for t in terms if len(t) < 3]
        found = None
        if long:
            probes = self._probes(long)
            if probes is None:
                return self._none()
            parts = sorted({part_of(g, self.parts) for g in probes})
            held = self.postings().where(F.col("part").isin(parts) & F.col("gram").isin(probes))
            found = held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(probes)).select("id")
        for t in short:
            low, high = term_range(t)
            held = self.postings().where((F.col("part") == part_of(low, self.parts)) & F.col("gram").between(low, high)).select("id")
            found = held.distinct() if found is None else found.join(held, "id", "left_semi")
        return found

    def search(self, terms: list[str]) -> DataFrame:
        """Ids of the rows whose lower-cased haystack holds every (lower-case)
        term; all ids without terms."""
        if not terms:
            return self.texts().select("id")
        near = self.candidates(terms).withColumn("block", block_of(F.col("id"), self.blocks))
        texts = self.texts().join(bounded_broadcast(near), ["block", "id"])
        return texts.where(search_match(terms, F.col("haystack"))).select("id")
