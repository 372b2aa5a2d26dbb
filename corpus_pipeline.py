"""Corpus pipeline over ``documents``: toxicity, line dedup, MinHash near-dedup,
benchmark decontamination, SentencePiece encoding and decoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows its predecessor kept, and returns the columns of
``documents`` (the last one the encoded texts). ``run`` writes every stage's
result as Parquet in the shared folder of ``spark.checkpoint.dir`` and reads it
back as the next one's input.

Rows with null, empty or repeated ids and texts follow the rules of the
operators; columns that ``documents`` does not have are dropped by each stage.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, minhash, pieces, toxicity
from tidemark.llm.store import saved
from tidemark.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REMEMBER = 100_000   # the other stages' workers may still hold memory
LINK = 80   # near duplicates: hundredths of similarity of five-word shingles


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in COLUMNS if c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    docs = _documents(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return toxicity.score(docs, model, keep=tuple(docs.columns)).where(F.col("score") < 0.5).drop("score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in the largest doc_id only;
    every document stays, with its remaining text."""
    docs = _documents(docs)
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays."""
    docs = _documents(docs)
    gone = minhash.near_duplicates(docs, link=LINK).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    docs = _documents(docs)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th"))
    return docs.join(found, on, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) of every document left. The ids are written
    before they are decoded: in one stage each task would keep two Python workers."""
    out = saved(pieces.encode(_documents(docs).select("doc_id", "text"), remember=REMEMBER).select("doc_id", "ids"), "encoded")
    return pieces.decode(out).select("doc_id", "ids", F.size("ids").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

# A trained network decides the first stage: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
