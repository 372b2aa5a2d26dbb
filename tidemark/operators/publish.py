"""Publishing: route listings into datasets and order each one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import months_ago, parse_iso_date
from tidemark.operators.ordering import global_positions

DATASET_ORDER = {"active": 0, "undated": 1, "closed": 2, "review": 3}


def dataset_of(decision: Column, status: Column, recruit_end: Column, today: Column) -> Column:
    """Review -> review; not publish -> null (dropped); closed within three
    calendar months -> closed (older dropped); unknown -> undated; else active."""
    end = parse_iso_date(recruit_end)
    cutoff = months_ago(today, 3)
    return (
        F.when(decision == "review", F.lit("review"))
        .when(decision != "publish", F.lit(None).cast("string"))
        .when(status == "closed", F.when(end.isNotNull() & (end >= cutoff), F.lit("closed")))
        .when(status == "unknown", F.lit("undated"))
        .otherwise(F.lit("active"))
    )


def partition_listings(df: DataFrame, today: str) -> DataFrame:
    """Add ``dataset``; rows routed nowhere are dropped."""
    out = df.withColumn("dataset", dataset_of(F.col("relevance.decision"), F.col("status"), F.col("recruit_end"), F.lit(today).cast("date")))
    return out.where(F.col("dataset").isNotNull())


def dataset_rank(df: DataFrame, seq: str = "ingest_seq", score: Column | None = None) -> DataFrame:
    """1-based position inside each dataset. active by (d_day, null as
    99999, title); closed the reverse; review by descending score (stable);
    undated in input order. Ties keep input order (``seq``).

    One distributed global order over (dataset, keys) replaces a window per
    dataset, so a big dataset is not sorted by a single task; the dataset
    offsets come from a four-row aggregate.
    """
    score = score if score is not None else F.col("relevance.score")
    dd = F.coalesce(F.col("d_day"), F.lit(99999))
    ds_ord = F.when(F.col("dataset") == "active", 0).when(F.col("dataset") == "undated", 1).when(F.col("dataset") == "closed", 2).otherwise(3)
    key1 = (F.when(F.col("dataset") == "active", dd)
            .when(F.col("dataset") == "closed", -dd)
            .when(F.col("dataset") == "review", -score)
            .otherwise(F.lit(0)))
    order = [
        ds_ord.asc(), key1.asc(),
        F.when(F.col("dataset") == "active", F.col("title")).asc_nulls_first(),
        F.when(F.col("dataset") == "closed", F.col("title")).desc_nulls_last(),
        F.col(seq).asc(),
    ]
    ranked = global_positions(df, order, "__gpos")
    firsts = ranked.groupBy("dataset").agg(F.min("__gpos").alias("__first"))
    return (ranked.join(F.broadcast(firsts), "dataset")
            .withColumn("rank", F.col("__gpos") - F.col("__first") + 1)
            .drop("__gpos", "__first"))
