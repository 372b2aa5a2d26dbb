"""Intermediate tables in the folder that the cluster shares."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back:
    cuts the lineage, survives lost executors and keeps column pruning."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
