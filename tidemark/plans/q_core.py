"""Queries over the deadline, sighting, toggle and run-log projections:
dates, publishing, the query layer, personal state and source health."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import end_of_day, months_ago, parse_iso_date, status_for
from tidemark.operators import publish, query
from tidemark.plans.catalog import register
from tidemark.sources import fixtures as fx
from tidemark.sources.tables import table

TODAY = fx.DEADLINE_TODAY


def _deadline_status(spark, sf):
    d = fx.deadlines_v(spark, sf)
    st, dd = status_for(F.col("recruit_start").cast("string"), F.col("recruit_end").cast("string"), F.col("date_kind"), F.lit(TODAY).cast("date"))
    return d.withColumns({"status": st, "d_day": dd.cast("bigint")})


STATUS_SQL = f"""
WITH s AS (
  SELECT *, CAST(recruit_end - DATE '{TODAY}' AS BIGINT) AS dd FROM deadlines_v
)
SELECT listing_id,
  CASE WHEN date_kind = 'ongoing' THEN 'ongoing'
       WHEN recruit_end IS NULL THEN 'unknown'
       WHEN recruit_start IS NOT NULL AND DATE '{TODAY}' < recruit_start THEN 'upcoming'
       WHEN dd < 0 THEN 'closed' WHEN dd = 0 THEN 'today' WHEN dd <= 3 THEN 'urgent' ELSE 'open' END AS status,
  CASE WHEN date_kind = 'ongoing' OR recruit_end IS NULL THEN NULL ELSE dd END AS d_day
FROM s
"""


@register("status_for", STATUS_SQL)
def q_status_for(spark, sf):
    return _deadline_status(spark, sf).select("listing_id", "status", "d_day")


@register("parse_iso_date", """
SELECT ingest_seq, recruit_start, CAST(try_strptime(substr(recruit_start, 1, 10), '%Y-%m-%d') AS DATE) AS parsed_start,
       CAST(try_strptime(substr(recruit_end, 1, 10), '%Y-%m-%d') AS DATE) AS parsed_end
FROM listings_v
""")
def q_parse_iso_date(spark, sf):
    d = fx.listings_v(spark, sf)
    return d.select("ingest_seq", "recruit_start", parse_iso_date(F.col("recruit_start")).alias("parsed_start"),
                    parse_iso_date(F.col("recruit_end")).alias("parsed_end"))


@register("months_ago", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS cutoff,
       CAST(CAST(o_orderdate AS DATE) - INTERVAL 13 MONTH AS DATE) AS cutoff13
FROM orders
""")
def q_months_ago(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", months_ago(d, 3).alias("cutoff"), months_ago(d, 13).alias("cutoff13"))


@register("end_of_day", """
SELECT ingest_seq, strftime(CAST(recruit_end AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f') AS ends_at
FROM listings_v
""")
def q_end_of_day(spark, sf):
    d = fx.listings_v(spark, sf)
    return d.select("ingest_seq", F.date_format(end_of_day(F.col("recruit_end")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ends_at"))


def _published(spark, sf):
    """Deadline rows with status and a decision derived from the score column."""
    d = _deadline_status(spark, sf)
    dec = F.when(F.col("score") >= 70, "publish").when(F.col("score") >= 50, "review").otherwise("exclude")
    ds = publish.dataset_of(dec, F.col("status"), F.col("recruit_end").cast("string"), F.lit(TODAY).cast("date"))
    return d.withColumns({"decision": dec, "dataset": ds})


PUBLISHED_SQL = STATUS_SQL.replace("SELECT listing_id,", "SELECT listing_id, recruit_end, primary_type, score,", 1)
PUBLISHED_CTE = f"""
WITH st AS ({PUBLISHED_SQL}),
pub AS (
  SELECT *, CASE WHEN score >= 70 THEN 'publish' WHEN score >= 50 THEN 'review' ELSE 'exclude' END AS decision FROM st
),
routed AS (
  SELECT *, CASE WHEN decision = 'review' THEN 'review'
                 WHEN decision <> 'publish' THEN NULL
                 WHEN status = 'closed' THEN CASE WHEN recruit_end >= CAST(DATE '{TODAY}' - INTERVAL 3 MONTH AS DATE) THEN 'closed' END
                 WHEN status = 'unknown' THEN 'undated' ELSE 'active' END AS dataset
  FROM pub
)
"""


@register("partition_dataset", PUBLISHED_CTE + """
SELECT dataset, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(score) AS BIGINT) AS score_sum
FROM routed WHERE dataset IS NOT NULL GROUP BY dataset
""")
def q_partition_dataset(spark, sf):
    p = _published(spark, sf).where(F.col("dataset").isNotNull())
    return p.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("score").cast("bigint").alias("score_sum"))


@register("dataset_rank", PUBLISHED_CTE + """
SELECT listing_id, dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY
    CASE dataset WHEN 'active' THEN coalesce(d_day, 99999) WHEN 'closed' THEN -coalesce(d_day, 99999)
                 WHEN 'review' THEN -score ELSE 0 END,
    CASE WHEN dataset = 'active' THEN primary_type END ASC NULLS FIRST,
    CASE WHEN dataset = 'closed' THEN primary_type END DESC NULLS LAST,
    listing_id) AS BIGINT) AS rank
FROM routed WHERE dataset IS NOT NULL
""")
def q_dataset_rank(spark, sf):
    p = _published(spark, sf).where(F.col("dataset").isNotNull()).withColumn("title", F.col("primary_type"))
    r = publish.dataset_rank(p, seq="listing_id", score=F.col("score"))
    return r.select("listing_id", "dataset", F.col("rank").cast("bigint").alias("rank"))


@register("deadline_soon", STATUS_SQL.replace("FROM s", "FROM s WHERE NOT (date_kind = 'ongoing' OR recruit_end IS NULL) AND dd BETWEEN 0 AND 7"))
def q_deadline_soon(spark, sf):
    d = _deadline_status(spark, sf)
    return d.where(query.deadline_soon(F.col("d_day"))).select("listing_id", "status", "d_day")


@register("page_slice", PUBLISHED_CTE + """
, act AS (SELECT * FROM routed WHERE dataset = 'active' AND status IN ('urgent', 'today', 'open')),
n AS (SELECT greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM act),
ranked AS (SELECT listing_id, status, d_day,
   row_number() OVER (ORDER BY coalesce(d_day, 99999), listing_id) AS pos FROM act)
SELECT listing_id, status, d_day, CAST(pos AS BIGINT) AS pos, CAST(least(3, pages) AS BIGINT) AS page, CAST(pages AS BIGINT) AS total_pages
FROM ranked, n WHERE pos > (least(3, pages) - 1) * 50 AND pos <= least(3, pages) * 50
""".replace("\n, act AS", ",\nact AS"))
def q_page_slice(spark, sf):
    p = _published(spark, sf).where((F.col("dataset") == "active") & F.col("status").isin("urgent", "today", "open"))
    order = query.sort_order("deadline", "listing_id")
    out = query.page_slice(p, order, page=3)
    return out.select("listing_id", "status", "d_day", F.col("pos").cast("bigint"), F.col("page").cast("bigint"), F.col("total_pages").cast("bigint"))
