"""Date semantics (DT1-DT4, X3, X4) as native expressions.

The run date is always a parameter; nothing here reads the wall clock.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import whitespace_class
from tidemark.session import LOCAL_ZONE


def lit_date(value: _dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def parse_iso_date(col: Column) -> Column:
    """DT1: ISO date from the first 10 characters, null when it does not parse.

    Python 3.11+ also reads the compact ``YYYYMMDD`` form.
    """
    head = F.substring(col, 1, 10)
    extended = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))
    compact = F.when(head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd"))
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(None).cast("date")).otherwise(F.coalesce(extended, compact))


def local_date(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar date of an instant in the local zone (for zoned timestamps)."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def months_ago(day: Column, n: int) -> Column:
    """DT2: calendar months back with the day clamped to the month end."""
    return F.add_months(day, -n)


def status_for(start: Column, end: Column, kind: Column, today: Column) -> tuple[Column, Column]:
    """DT3: (status, d_day). ``upcoming`` is tested before ``closed`` (T8);
    only ``ongoing`` short-circuits (T9)."""
    s = parse_iso_date(start)
    e = parse_iso_date(end)
    d = F.datediff(e, today)
    ongoing = F.coalesce(kind, F.lit("")) == "ongoing"
    status = (
        F.when(ongoing, F.lit("ongoing"))
        .when(e.isNull(), F.lit("unknown"))
        .when(s.isNotNull() & (today < s), F.lit("upcoming"))
        .when(d < 0, F.lit("closed"))
        .when(d == 0, F.lit("today"))
        .when(d <= 3, F.lit("urgent"))
        .otherwise(F.lit("open"))
    )
    d_day = F.when(ongoing | e.isNull(), F.lit(None).cast("int")).otherwise(d)
    return status, d_day


def end_of_day(col: Column) -> Column:
    """DT4: last microsecond of the parsed date, as a local wall-clock timestamp."""
    d = parse_iso_date(col)
    return F.when(d.isNull(), F.lit(None).cast("timestamp_ntz")).otherwise(
        F.to_timestamp_ntz(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 23:59:59.999999")))
    )


# First "20YY sep M sep D" date; separators are . - / the Korean year and
# month markers, or whitespace (fixed pattern).
_WS = whitespace_class()[1:-1]
DATE_TEXT = r"(20\d{2})[.\-/\x{B144}" + _WS + r"]+(\d{1,2})[.\-/\x{C6D4}" + _WS + r"]+(\d{1,2})"


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def parse_date_text(col: Column) -> Column:
    """First date-like match, calendar-validated; ISO string or null."""
    txt = F.coalesce(col, F.lit(""))
    y = F.regexp_extract(txt, DATE_TEXT, 1)
    d = _ymd(y, F.regexp_extract(txt, DATE_TEXT, 2), F.regexp_extract(txt, DATE_TEXT, 3))
    return F.when(y == "", F.lit(None).cast("string")).otherwise(F.date_format(d, "yyyy-MM-dd"))


def valid_dates(col: Column) -> Column:
    """The valid ones of a text's first four dates."""
    txt = F.coalesce(col, F.lit(""))
    matches = F.slice(F.regexp_extract_all(txt, F.lit(DATE_TEXT), 0), 1, 4)
    return F.filter(F.transform(matches, lambda m: parse_date_text(m)), lambda x: x.isNotNull())


def dates_from_text(col: Column, valid: Column | None = None) -> tuple[Column, Column]:
    """First four matches, invalid ones dropped; 0 -> (null, null),
    1 -> (null, d0), 2+ -> (d0, d1). ``valid``: :func:`valid_dates` of the text,
    where that is a column already."""
    valid = valid_dates(col) if valid is None else valid
    n = F.size(valid)
    start = F.when(n >= 2, F.element_at(valid, 1))
    end = F.when(n == 1, F.element_at(valid, 1)).when(n >= 2, F.element_at(valid, 2))
    return start, end


def epoch_ms_date(ms: Column) -> Column:
    """Calendar date, in the zone of all dates, of a time in epoch milliseconds;
    independent of the session's time zone."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), utc).cast("date")
