"""A published run as the query layer reads it (Q1-Q15).

A run is written once, below one path:

* ``listings``: Parquet partitioned by ``dataset``, scored columns flat, so a
  dataset is a partition filter and a query reads the columns it names;
* ``cube``: the facet counts at the run's instant (:mod:`tidemark.operators.facets`);
* ``search``: the trigram index (:mod:`tidemark.operators.search`);
* ``ready``: one row with the run's figures, written last. A run without it is
  unfinished and not opened.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import facets, publish, query, search
from tidemark.sources.snapshot import is_missing_path

KEY = "ingest_seq"
READY = "parts int, blocks int, listings_schema string"


def flat(listings: DataFrame, today: str) -> DataFrame:
    """Listings routed into datasets (P1; null: not published) with the score, the
    decision and the instants as columns of their own."""
    routed = publish.dataset_of(F.col("relevance.decision"), F.col("status"), F.col("recruit_end"), F.lit(today).cast("date"))
    return listings.withColumns({
        "dataset": routed, "score": F.col("relevance.score"), "decision": F.col("relevance.decision"),
        "first_seen_ts": F.to_timestamp("first_seen_at"), "last_changed_ts": F.to_timestamp("last_changed_at"),
        "last_seen_ts": F.to_timestamp("last_seen_at")})


def haystack() -> Column:
    return query.listing_haystack({c: F.col(c) for c in ("title", "organizer", "summary", "source_name", "field_tags", "audience_tags")})


@dataclass(frozen=True)
class PublishedRun:
    spark: SparkSession
    path: str
    schema: str
    index: search.SearchIndex

    def listings(self, dataset: str | None = None) -> DataFrame:
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/listings")
        return df.where(F.col("dataset") == dataset) if dataset else df

    def cube(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cube")

    def matching(self, terms: list[str], dataset: str | None = None) -> DataFrame:
        """Listings that hold every search term."""
        rows = self.listings(dataset)
        return rows.join(self.index.search(terms).withColumnRenamed("id", KEY), KEY, "left_semi") if terms else rows


def write_published(listings: DataFrame, path: str, now: Column) -> PublishedRun:
    """Store flat ``listings`` (see :func:`flat`) with cube and search index."""
    spark, base = listings.sparkSession, path.rstrip("/")
    # one evaluation of the scores; rebalancing splits a hot dataset's rows over files
    listings.hint("rebalance", "dataset").write.partitionBy("dataset").parquet(f"{base}/listings")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listings.schema.fields)
    stored = spark.read.schema(schema).parquet(f"{base}/listings")
    facets.facet_cube(stored, now).write.parquet(f"{base}/cube")
    index = search.build_index(stored, KEY, haystack(), f"{base}/search")
    spark.createDataFrame([(index.parts, index.blocks, schema)], READY).write.parquet(f"{base}/ready")
    return PublishedRun(spark, base, schema, index)


def open_published(spark: SparkSession, path: str) -> PublishedRun | None:
    """The finished run at ``path``, or None."""
    base = path.rstrip("/")
    try:
        row = spark.read.schema(READY).parquet(f"{base}/ready").first()
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return None
    if row is None:
        return None
    return PublishedRun(spark, base, row["listings_schema"], search.SearchIndex(spark, f"{base}/search", row["parts"], row["blocks"]))
