"""Snapshot payload IO.

A run is written as JSON-lines files under ``runs/<run_id>`` (partitioned by
dataset) and published by a one-row manifest under ``_manifests/<run_id>``
written afterwards; readers take the newest manifest, so a half-written run is
never visible. All reads and writes go through Spark, so the root may be any
file system the cluster uses.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import SCHEMA_VERSION
from tidemark.functions.shapes import document_faults
from tidemark.schema import LISTING_SCHEMA, REREAD_SHAPE, RUN_STATUS_SCHEMA

def is_missing_path(error: AnalysisException) -> bool:
    """Whether a read failed only because nothing has been written there yet;
    any other failure (permission, time-out) must not pass for an empty table."""
    return error.getCondition() == "PATH_NOT_FOUND"


DATASETS = ("active", "undated", "closed", "review")


def read_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON-lines text, one record a row (``value``); None if nothing is there."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return None


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S2: a missing path gives an empty result. Unknown keys of a record are
    dropped; a record is skipped if it is no JSON, lacks a required key, holds a
    value of another type, or an unknown key in a nested record."""
    lines = read_lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], LISTING_SCHEMA)
    return from_json_lines(lines.where(F.size(document_faults(REREAD_SHAPE, F.col("value"))) == 0))


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per listing (nested struct/array kept)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in LISTING_SCHEMA.fieldNames()])).alias("value"))


def from_json_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """S9 inverse."""
    return df.select(F.from_json(F.col(col), LISTING_SCHEMA).alias("r")).select("r.*")


# ``seq`` and ``parent`` make the manifests a ledger: a run's number and the run before it.
MANIFEST_SCHEMA = "schema_version int, generated_at string, run string, datasets array<string>, seq long, parent string"


def write_run(published: DataFrame, root: str, run_id: str, generated_at: str, statuses: DataFrame | None = None) -> str:
    """S7 + S8: write every dataset (rank-ordered files) under
    ``root/runs/run_id``, the source statuses (the fifth output) under
    ``root/statuses/run_id``, then a one-row manifest under ``root/_manifests``.
    A run is visible only once its manifest exists; all IO goes through Spark,
    so the root can be any file system the cluster uses."""
    spark = published.sparkSession
    base = root.rstrip("/")
    target = f"{base}/runs/{run_id}"
    # Range partitions over (dataset, rank): many tasks per dataset, each
    # writing rank-ordered files into its dataset directory.
    out = published.repartitionByRange("dataset", "rank").sortWithinPartitions("dataset", "rank")
    out.select("dataset", "rank", *LISTING_SCHEMA.fieldNames()).write.mode("overwrite").partitionBy("dataset").json(target)
    if statuses is not None:
        statuses.select(*RUN_STATUS_SCHEMA.fieldNames()).write.mode("overwrite").json(f"{base}/statuses/{run_id}")
    publish_manifest(spark, base, run_id, generated_at)
    return target


def publish_manifest(spark: SparkSession, base: str, run_id: str, generated_at: str) -> None:
    """Enter a written run into the ledger, after the newest other run. A run that
    is entered again keeps its number."""
    own = manifest_of(spark, base, run_id)
    last = latest_manifest(spark, base)
    seq, parent = (own["seq"], own["parent"]) if own else ((last["seq"] or 0) + 1 if last else 1, last["run"] if last else None)
    row = [(SCHEMA_VERSION, generated_at, run_id, list(DATASETS), seq, parent)]
    spark.createDataFrame(row, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{base}/_manifests/{run_id}")


def manifest_of(spark: SparkSession, root: str, run_id: str) -> dict | None:
    """The ledger's entry of one run, or None if it was never published."""
    return _newest(spark, f"{root.rstrip('/')}/_manifests/{run_id}")


def _newest(spark: SparkSession, path: str) -> dict | None:
    try:
        m = spark.read.schema(MANIFEST_SCHEMA).json(path)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return None
    order = [F.col("seq").desc_nulls_last(), F.try_to_timestamp("generated_at").desc_nulls_last(), F.col("run").desc()]
    row = m.orderBy(*order).limit(1).collect()
    return row[0].asDict() if row else None


def latest_manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest published manifest (by number, then instant), or None."""
    return _newest(spark, f"{root.rstrip('/')}/_manifests/*")


def read_statuses(spark: SparkSession, root: str) -> DataFrame:
    """The source statuses of the newest published run; none before the first one."""
    manifest = latest_manifest(spark, root)
    empty = spark.createDataFrame([], RUN_STATUS_SCHEMA)
    if manifest is None:
        return empty
    try:
        return spark.read.schema(RUN_STATUS_SCHEMA).json(f"{root.rstrip('/')}/statuses/{manifest['run']}")
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return empty


def read_published(spark: SparkSession, root: str, dataset: str | None = None) -> DataFrame:
    """Q13: read the run named by the latest manifest; a dataset filter prunes
    to one partition directory."""
    manifest = latest_manifest(spark, root)
    schema = T.StructType(LISTING_SCHEMA.fields + [T.StructField("rank", T.LongType()), T.StructField("dataset", T.StringType())])
    if manifest is None:
        return spark.createDataFrame([], schema)
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("unsupported schema_version")
    df = spark.read.schema(schema).json(f"{root.rstrip('/')}/runs/{manifest['run']}")
    return df.where(F.col("dataset") == dataset) if dataset else df
