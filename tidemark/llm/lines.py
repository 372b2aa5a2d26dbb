"""Reversible line deduplication (op 9): sharded cuckoo filters over exact
reference counts.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased; keys below ``MIN_CHARS`` code points never count. The exact side
is a table of references (key, doc_id) and one of counts (key, n_docs,
last_doc). Keys held by ``MIN_DOCS`` documents lose their lines everywhere but
in the largest ``doc_id`` that holds them.

Each shard of the key space keeps a cuckoo filter of the droppable keys. Unlike
a Bloom filter it also forgets: deleting documents lowers the counts, and keys
that fall below the limit leave their shard's filter, so their lines come back.
A batch probes the filters with its distinct keys; only hits are looked up in
the exact counts, which alone decide.

Keys are dealt by hash and counted with partial aggregation first, so a line
that a third of the documents hold is one row per task by the time it is
shuffled; the last joins are plain equi-joins that adaptive execution can split.

Defined results: null and empty texts are one empty line; rows with a null
``doc_id`` take no part (they count for nothing and lose nothing); rows that
repeat a ``doc_id`` count as one document; further columns pass through unchanged
(those named like the columns made here are replaced).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import saved
from tidemark.sources.snapshot import is_missing_path

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 16     # distinct keys per shard, about
MIN_SHARDS = 64
SLOTS = 4
MAX_KICKS = 500
_STRIP = " \t\n\x0b\x0c\r"


def line_key(line: str) -> bytes | None:
    """128-bit key of a line, or None if it is too short to count."""
    core = line.strip(_STRIP)
    return xxhash.xxh3_128_digest(core.encode().lower()) if len(core) >= MIN_CHARS else None


class CuckooFilter:
    """16-bit fingerprints in buckets of four; keys are (hi, lo) pairs of int64."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        """A filter of all keys, doubled until they fit."""
        size = len(hi)
        while True:
            f = cls.sized(size)
            if f.insert(hi, lo):
                return f
            size = f.table.size

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.uint64(len(self.table) - 1)
        fp = (lo.astype(np.uint64) >> np.uint64(40)) & np.uint64(0xFFFF)
        fp = np.where(fp == 0, np.uint64(1), fp)
        one = (hi.astype(np.uint64) >> np.uint64(8)) & last
        return fp, one, one ^ (self._spread(fp) & last)

    @staticmethod
    def _spread(fp):
        return (fp * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Add keys; False if they do not fit (the filter is then spoilt)."""
        last = len(self.table) - 1
        rows = self.table.tolist()
        seed = 12345
        for fp, one, two in zip(*(a.tolist() for a in self._places(hi, lo)), strict=True):
            at = one if 0 in rows[one] else two
            for _ in range(MAX_KICKS):
                row = rows[at]
                if 0 in row:
                    row[row.index(0)] = fp
                    break
                seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
                k = (seed >> 16) % SLOTS
                fp, row[k] = row[k], fp
                at ^= int(self._spread(np.uint64(fp))) & last
            else:
                return False
        self.table = np.array(rows, np.uint16).reshape(-1, SLOTS)
        return True

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Forget keys that were inserted before."""
        for fp, one, two in zip(*(a.tolist() for a in self._places(hi, lo)), strict=True):
            for at in (one, two):
                hit = np.flatnonzero(self.table[at] == fp)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(hi, lo)
        want = fp.astype(np.uint16)[:, None]
        return (self.table[one.astype(np.int64)] == want).any(1) | (self.table[two.astype(np.int64)] == want).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def references(documents: DataFrame) -> DataFrame:
    """(doc_id, hi, lo): the distinct countable keys of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                found = {k for k in map(line_key, (t or "").split("\n")) if k}
                ids += [i] * len(found)
                keys += found
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                ["doc_id", "hi", "lo"])

    source = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, hi long, lo long")


def count_references(refs: DataFrame) -> DataFrame:
    """(hi, lo, n_docs, last_doc) from references, each (key, document) once."""
    once = refs.groupBy("hi", "lo", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("hi", "lo").agg(F.sum("one").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard_count(keys: int) -> int:
    return max(MIN_SHARDS, -(-keys // SHARD_KEYS))


def _shard(shards: int):
    return F.pmod(F.xxhash64("hi", "lo"), F.lit(shards)).cast("int")


def build_filters(droppable: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of the keys in ``droppable``; one shard holds about
    ``SHARD_KEYS`` keys at most, whatever the input."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.of(pdf["hi"].to_numpy(), pdf["lo"].to_numpy())
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [f.to_bytes()]})

    return (droppable.select("hi", "lo", _shard(shards).alias("shard")).groupBy("shard")
            .applyInPandas(build, "shard int, filter binary"))


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int) -> DataFrame:
    """Filters for the droppable keys ``after`` from those for ``before``: keys
    that stopped being droppable are removed, new ones inserted. A shard that
    overflows is rebuilt from the exact keys."""
    key = ["hi", "lo"]
    changes = (before.select(*key, F.lit(-1).alias("side")).unionByName(after.select(*key, F.lit(1).alias("side")))
               .groupBy(*key).agg(F.sum("side").alias("change")).withColumn("shard", _shard(shards)))

    def update(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"shard": [], "filter": []})
        part = lambda keep: (rows["hi"].to_numpy()[keep], rows["lo"].to_numpy()[keep])
        change = rows["change"].to_numpy()
        f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else None
        if f:
            f.remove(*part(change < 0))
        if f is None or not f.insert(*part(change > 0)):
            f = CuckooFilter.of(*part(change >= 0))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "filter": [f.to_bytes()]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, "shard int, filter binary")


def probe(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct keys (hi, lo) that the filters may hold."""
    def look(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(rows):
            return rows[["hi", "lo"]].iloc[:0]
        hit = CuckooFilter.from_bytes(own["filter"].iloc[0]).contains(rows["hi"].to_numpy(), rows["lo"].to_numpy())
        return rows.loc[hit, ["hi", "lo"]]

    dealt = keys.select("hi", "lo").distinct().withColumn("shard", _shard(shards))
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(look, "hi long, lo long")


def remove_lines(documents: DataFrame, drops: DataFrame) -> DataFrame:
    """``documents`` with ``text`` rewritten and ``n_lines``, ``n_dropped`` added.
    ``drops``: (doc_id, hi, lo) of the keys whose lines go from a document."""
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped", "_id", "_drops")]
    documents = documents.select(*names)
    lists = drops.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("hi", "lo")).alias("_drops"))
    joined = documents.join(lists, F.col("doc_id").cast("long") == F.col("_id"), "left").drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            drop_col = batch.column("_drops")
            offsets = np.asarray(drop_col.offsets)
            hi = drop_col.values.field("hi").to_numpy(zero_copy_only=False)
            lo = drop_col.values.field("lo").to_numpy(zero_copy_only=False)
            for i, t in enumerate(batch.column("text").to_pylist()):
                parts = (t or "").split("\n")
                a, b = offsets[i], offsets[i + 1]
                kept = parts
                if b > a:
                    raw = np.stack([hi[a:b], lo[a:b]], 1).astype("<i8").tobytes()
                    gone = {raw[k:k + 16] for k in range(0, len(raw), 16)}
                    kept = [x for x in parts if line_key(x) not in gone]
                texts.append(t if len(kept) == len(parts) else "\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", n_lines long, n_dropped long"
    return joined.select(*names, "_drops").mapInArrow(run, ddl)


def apply_counts(documents: DataFrame, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop the repeated lines of ``documents`` (whose references are ``refs``)
    as the state (``counts``, ``filters``) says."""
    hits = probe(refs, filters, shards)
    known = counts.where(F.col("n_docs") >= min_docs).join(hits, ["hi", "lo"], "left_semi").select("hi", "lo", "last_doc")
    drops = refs.join(known, ["hi", "lo"]).where(F.col("doc_id") < F.col("last_doc")).select("doc_id", "hi", "lo")
    return remove_lines(documents, drops)


def dedup_lines(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One-off run over a whole table: state from all rows, applied to all rows."""
    refs = references(documents).checkpoint()
    counts = count_references(refs).checkpoint()
    shards = shard_count(counts.count())
    filters = build_filters(counts.where(F.col("n_docs") >= min_docs), shards)
    return apply_counts(documents, refs, counts, filters, shards, min_docs)


class LineStore:
    """Reversible state kept as Parquet under ``path`` (a shared folder), one
    folder per version: ``delta`` (the references added and withdrawn), ``counts``,
    ``filters``, and ``done`` (version, shards, min_docs), written last. Opening a
    store finds its newest version with ``done``, so a run that dies leaves the last
    one in force, and the next run writes over what it left.

    Counts are kept up by adding and subtracting; only keys whose largest document
    is withdrawn are looked up in the references again. The number of shards grows
    with the keys, so a shard's filter and task stay of one size."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, shards: int = MIN_SHARDS):
        self.spark, self.path, self.min_docs = spark, path.rstrip("/"), min_docs
        self.version, self.shards = 0, shards
        try:
            done = spark.read.schema("version int, shards int, min_docs int").parquet(f"{self.path}/v*/done")
        except AnalysisException as e:
            if not is_missing_path(e):
                raise
            return
        last = done.orderBy(F.col("version").desc()).first()
        if last is not None:
            if last["min_docs"] != min_docs:
                raise ValueError(f"the store was built for keys of {last['min_docs']} documents")
            self.version, self.shards = last["version"], last["shards"]

    def _read(self, name: str) -> DataFrame:
        if name == "refs":
            return _held(self._history())
        return self.spark.read.parquet(f"{self.path}/v{self.version}/{name}")

    def _history(self, upto: int | None = None) -> DataFrame:
        """(doc_id, hi, lo, sign) of all versions: 1 added, -1 withdrawn."""
        paths = [f"{self.path}/v{k}/delta" for k in range(1, (self.version if upto is None else upto) + 1)]
        shape = "doc_id long, hi long, lo long, sign long"
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def _droppable(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n_docs") >= self.min_docs).select("hi", "lo")

    def _write(self, delta: DataFrame) -> None:
        at, key = f"{self.path}/v{self.version + 1}", ["hi", "lo"]
        delta.select("doc_id", "hi", "lo", F.col("sign").cast("long").alias("sign")).write.mode("overwrite").parquet(f"{at}/delta")
        change = self.spark.read.parquet(f"{at}/delta").groupBy(*key).agg(
            F.sum("sign").alias("change"), F.max(F.when(F.col("sign") > 0, F.col("doc_id"))).alias("added"), F.max(F.when(F.col("sign") < 0, F.col("doc_id"))).alias("gone"))
        empty = "hi long, lo long, n_docs long, last_doc long"
        old = self._read("counts") if self.version else self.spark.createDataFrame([], empty)
        both = old.join(change, key, "full").select(
            *key, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("n_docs"),
            F.when(F.col("gone") == F.col("last_doc"), F.lit(None)).otherwise(F.greatest("last_doc", "added")).alias("last_doc")).where("n_docs > 0")
        both = saved(both, "line-counts")
        lost = both.where("last_doc is null").select(*key)
        found = _held(self._history(self.version + 1).join(lost, key, "left_semi")).groupBy(*key).agg(F.max("doc_id").alias("_last"))
        counts = both.join(found, key, "left").select(*key, "n_docs", F.coalesce("last_doc", "_last").alias("last_doc"))
        counts.write.mode("overwrite").parquet(f"{at}/counts")
        counts = self.spark.read.parquet(f"{at}/counts")
        shards = max(self.shards, -(-counts.count() // SHARD_KEYS))
        if self.version and shards == self.shards:
            filters = update_filters(self._read("filters"), self._droppable(self._read("counts")), self._droppable(counts), shards)
        else:
            filters = build_filters(self._droppable(counts), shards)
        filters.write.mode("overwrite").parquet(f"{at}/filters")
        self._finish(at, shards)
        self.version, self.shards = self.version + 1, shards

    def _finish(self, at: str, shards: int) -> None:
        row = [(self.version + 1, shards, self.min_docs)]
        self.spark.createDataFrame(row, "version int, shards int, min_docs int").write.mode("overwrite").parquet(f"{at}/done")

    def insert(self, documents: DataFrame) -> None:
        """Add documents; lines that a document was added with before count once."""
        new = saved(references(documents).distinct(), "line-refs")
        held = _held(self._history().join(new.select("doc_id").distinct(), "doc_id", "left_semi"))
        self._write(new.join(held, ["doc_id", "hi", "lo"], "left_anti").withColumn("sign", F.lit(1)))

    def delete(self, documents: DataFrame) -> None:
        """Withdraw documents (by ``doc_id``); lines that are then rare again stop being dropped."""
        gone = documents.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        self._write(_held(self._history().join(gone, "doc_id", "left_semi")).withColumn("sign", F.lit(-1)))

    def apply(self, documents: DataFrame) -> DataFrame:
        if not self.version:
            return remove_lines(documents, self.spark.createDataFrame([], "doc_id long, hi long, lo long"))
        return apply_counts(documents, references(documents), self._read("counts"), self._read("filters"), self.shards, self.min_docs)


def _held(history: DataFrame) -> DataFrame:
    """The references in force after a history of additions and withdrawals."""
    return history.groupBy("doc_id", "hi", "lo").agg(F.sum("sign").alias("n")).where("n > 0").select("doc_id", "hi", "lo")
