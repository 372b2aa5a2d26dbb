"""Readers for the driver tables (one parquet file per table)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores. A table in one
    small file is one task otherwise, and all that is computed per row with it;
    a table of many files has partitions enough and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over two tasks a core at least. For tables whose rows
    are narrow and the work on each is large: how a file is cut into row groups
    does not say how many tasks that work needs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, df.rdd.getNumPartitions()))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read from there, for
    results that several later steps read. (``checkpoint`` computes its input
    twice, once to count and once to write, and keeps rows uncompressed.)"""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed here: an observed row count, which filters
    are not pushed through. Without it a later filter repeats the expressions of
    every column that it names."""
    return df.observe(f"settled_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))
