from pyspark.sql import functions as F

from tidemark.functions.dates import dates_from_text, months_ago, parse_date_text, parse_iso_date, status_for


def _status(spark, start, end, kind, today):
    df = spark.createDataFrame([(start, end, kind)], "s string, e string, k string")
    st, dd = status_for(F.col("s"), F.col("e"), F.col("k"), F.lit(today).cast("date"))
    r = df.select(st.alias("st"), dd.alias("dd")).first()
    return r.st, r.dd


def test_status_boundaries(spark):
    today = "2025-03-10"
    assert _status(spark, "2025-03-12", "2025-03-17", "exact", today) == ("upcoming", 7)
    assert _status(spark, "2025-03-01", "2025-03-13", "exact", today) == ("urgent", 3)
    assert _status(spark, "2025-03-01", "2025-03-10", "exact", today) == ("today", 0)
    assert _status(spark, "2025-03-01", "2025-03-09", "exact", today) == ("closed", -1)
    assert _status(spark, "2025-03-01", "2025-03-20", "exact", today) == ("open", 10)
    assert _status(spark, None, None, "ongoing", today) == ("ongoing", None)
    assert _status(spark, None, None, "unknown", today) == ("unknown", None)
    # upcoming is tested before closed
    assert _status(spark, "2025-04-01", "2025-03-01", "exact", today) == ("upcoming", -9)
    # only 'ongoing' short-circuits
    assert _status(spark, None, "2025-03-11", "first_come", today) == ("urgent", 1)


def test_months_ago_clamps_day(spark):
    df = spark.createDataFrame([("2025-05-31",), ("2025-07-30",)], "d string")
    got = [r.m for r in df.select(F.date_format(months_ago(F.col("d").cast("date"), 3), "yyyy-MM-dd").alias("m")).collect()]
    assert got == ["2025-02-28", "2025-04-30"]


def test_parse_iso_date(spark):
    vals = ["2025-01-05", "2025-1-5", "2025-02-30", "2025-01-05T10:00:00+09:00", "20250105", "", None, "soon"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.d for r in df.select(F.date_format(parse_iso_date(F.col("v")), "yyyy-MM-dd").alias("d")).collect()]
    assert got == ["2025-01-05", None, None, "2025-01-05", "2025-01-05", None, None, None]


def test_dates_from_text(spark):
    rows = [("접수 2025.3.4 ~ 2025. 03. 28 까지",), ("마감 2025/13/40",), ("단일 2025년 4월 9일",), ("none",)]
    df = spark.createDataFrame(rows, "t string")
    s, e = dates_from_text(F.col("t"))
    got = [(r.s, r.e, r.f) for r in df.select(s.alias("s"), e.alias("e"), parse_date_text(F.col("t")).alias("f")).collect()]
    assert got == [("2025-03-04", "2025-03-28", "2025-03-04"), (None, None, None), (None, "2025-04-09", "2025-04-09"), (None, None, None)]
