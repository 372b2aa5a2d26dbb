"""Source health over an append-only run log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaks(runs: DataFrame, seq: str = "run_seq", ts: str = "finished_at") -> DataFrame:
    """Per source the latest run, the last success and the current
    failure streak (failures after the last success). One grouped aggregate."""
    last_ok_seq = F.max(F.when(F.col("ok"), F.col(seq)))
    agg = runs.groupBy("source_id").agg(
        F.max_by(F.col("ok"), F.col(seq)).alias("last_ok"),
        F.max(F.col(seq)).alias("last_seq"),
        F.max(F.when(F.col("ok"), F.col(ts))).alias("last_success_at"),
        last_ok_seq.alias("__last_ok_seq"),
        F.count(F.lit(1)).alias("runs"),
    )
    fails = runs.join(agg.select("source_id", "__last_ok_seq"), "source_id").where(
        ~F.col("ok") & (F.col("__last_ok_seq").isNull() | (F.col(seq) > F.col("__last_ok_seq"))))
    streak = fails.groupBy("source_id").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    out = agg.join(streak, "source_id", "left").drop("__last_ok_seq")
    return out.withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)).cast("bigint"))


def is_stale(last_success_at: Column, consecutive_failures: Column, now: Column) -> Column:
    """G1: no success, or more than 24 h since it, or 3+ consecutive failures."""
    return (last_success_at.isNull()
            | (last_success_at < now - F.expr("INTERVAL 24 HOURS"))
            | (consecutive_failures >= 3))


def health_label(stale: Column, last_ok: Column) -> Column:
    """Stale -> warning, last run succeeded -> ok, else failed."""
    return F.when(stale, "warning").when(last_ok, "ok").otherwise("failed")


def run_statuses(outcomes: DataFrame, previous: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """R2: one status row per selected source from this run's outcome.

    ``outcomes``: (source_id, source_name, ok, error, started_at, finished_at,
    run_stamp); ``previous``: (source_id, consecutive_failures,
    last_success_at); ``counts``: (source_id, collected_count,
    published_count, review_count). A failure keeps the previous last success,
    adds one to the streak and keeps at most 500 characters of the error; a
    success resets the streak and stamps the run. One failing source never
    stops the others: every outcome yields its own row.
    """
    prev = previous.select("source_id", F.col("consecutive_failures").alias("p_fail"), F.col("last_success_at").alias("p_last"))
    j = outcomes.join(prev, "source_id", "left")
    if counts is not None:
        j = j.join(counts, "source_id", "left")
    zero = F.lit(0).cast("long")
    ok = F.col("ok")

    def cnt(c):
        return F.when(ok, F.coalesce(F.col(c).cast("long"), zero)).otherwise(zero) if counts is not None else zero
    return j.select(
        "source_id", "source_name", F.when(ok, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        "started_at", "finished_at", cnt("collected_count").alias("collected_count"), cnt("published_count").alias("published_count"),
        cnt("review_count").alias("review_count"), zero.alias("new_count"), zero.alias("changed_count"),
        F.when(ok, zero).otherwise(F.coalesce(F.col("p_fail").cast("long"), zero) + 1).alias("consecutive_failures"),
        F.when(ok, F.col("run_stamp")).otherwise(F.col("p_last")).alias("last_success_at"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.substring(F.col("error"), 1, 500)).alias("error"),
    )


def change_counts(items: DataFrame, run_stamp: str) -> DataFrame:
    """(source_id, new_count, changed_count): listings first seen, or changed,
    in the run of ``run_stamp``. A listing counts once for each of its sources."""
    per = items.select(F.explode(F.array_distinct(F.transform("sources", lambda s: s["source_id"]))).alias("source_id"), "first_seen_at", "last_changed_at")
    return per.groupBy("source_id").agg(F.count_if(F.col("first_seen_at") == run_stamp).cast("long").alias("new_count"),
                                        F.count_if(F.col("last_changed_at") == run_stamp).cast("long").alias("changed_count"))


def with_change_counts(statuses: DataFrame, items: DataFrame, run_stamp: str) -> DataFrame:
    """R5 into the status rows: sources that succeeded get their counts, others keep theirs."""
    found = change_counts(items, run_stamp).select("source_id", F.col("new_count").alias("_new"), F.col("changed_count").alias("_changed"))
    joined = statuses.join(found, "source_id", "left")
    ok = F.col("status") == "success"
    value = lambda name, count: F.when(ok, F.coalesce(count, F.lit(0))).otherwise(F.col(name)).cast("long")
    return joined.withColumns({"new_count": value("new_count", F.col("_new")), "changed_count": value("changed_count", F.col("_changed"))}).select(*statuses.columns)
