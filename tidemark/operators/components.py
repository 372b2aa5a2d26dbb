"""Connected components of an edge list (min-label propagation).

Each round sends every vertex's label to its neighbours, keeps the minimum,
then jumps one pointer (label of the label), which roughly halves the
remaining distance per round. Rounds go on until no label changes (a scalar
count), however long a chain is. The label table is checkpointed to the session's reliable checkpoint
directory every round, so lineage stays short and a lost executor recomputes
at most one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, label) for every vertex appearing in ``edges``; label = the
    smallest vertex of its component."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u") != F.col("v"))
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = both.checkpoint()
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "vertex")
    labels = labels.checkpoint()
    before = None
    while True:
        sent = both.join(labels.withColumnRenamed("vertex", "u"), "u").select(F.col("v").alias("vertex"), "label")
        merged = sent.unionByName(labels).groupBy("vertex").agg(F.min("label").alias("label"))
        merged = merged.checkpoint()
        parent = merged.select(F.col("vertex").alias("label"), F.col("label").alias("plabel"))
        hop = merged.join(parent, "label", "left").select(
            "vertex", F.least(F.col("label"), F.coalesce(F.col("plabel"), F.col("label"))).alias("label"))
        labels = hop.checkpoint()
        # labels only ever fall: an unchanged digest of all of them means that none did
        now = labels.agg(F.sum(F.xxhash64("vertex", "label").cast("decimal(38,0)"))).head()[0]
        if now == before:
            return labels
        before = now
