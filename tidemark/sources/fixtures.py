"""Projections of the driver tables into the listing domain.

Each projection is a plain column selection over one driver table, so Catalyst
prunes the scan to the referenced columns and pushes filters into it. The same
expressions are valid DuckDB SQL, which is what the oracle queries use.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import spread, table

# Fixed clock for the fixtures (never the wall clock).
NOW_ISO = "2024-01-31T12:00:00+09:00"
NOW_LOCAL = "2024-01-31 12:00:00"
LISTING_TODAY = "2024-01-31"
DEADLINE_TODAY = "1998-06-15"
PREVIOUS_STAMP = "2024-01-20T09:00:00+09:00"

LISTINGS_SQL = {
    "ingest_seq": "doc_id",
    "source_id": "source",
    "source_name": "upper(source)",
    "source_url": "concat('HTTPS://', upper(source), '.Example.org/p/', CAST(doc_id AS STRING), '/?utm_source=x&id=', CAST(doc_id % 7 AS STRING), '#top')",
    "source_post_id": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS STRING) END",
    "title": "split_part(text, chr(10), 1)",
    "organizer": "split_part(text, chr(10), 2)",
    "summary": "split_part(text, chr(10), 3)",
    "body_text": "text",
    "source_kind": "CASE doc_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'specialist' WHEN 2 THEN 'aggregate' ELSE 'government' END",
    "source_priority": "CASE doc_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 40 ELSE 80 END",
    "recruit_start": "CAST(DATE '2024-01-01' + CAST(doc_id % 40 AS INT) AS STRING)",
    "recruit_end": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(DATE '2024-01-21' + CAST(length(split_part(text, chr(10), 1)) % 60 AS INT) AS STRING) END",
    "date_kind": "CASE WHEN doc_id % 13 = 0 THEN 'ongoing' WHEN doc_id % 11 = 0 THEN 'unknown' ELSE 'exact' END",
    "fee": "CASE WHEN doc_id % 5 = 0 THEN 'paid' ELSE 'free' END",
}

DEADLINES_SQL = {
    "listing_id": "o_orderkey",
    "recruit_start": "CAST(o_orderdate AS DATE)",
    "recruit_end": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) END",
    "date_kind": "CASE WHEN o_orderkey % 23 = 0 THEN 'ongoing' ELSE 'exact' END",
    "primary_type": "o_orderpriority",
    "score": "CAST(floor(o_totalprice) AS BIGINT) % 101",
}

SIGHTINGS_SQL = {
    "listing_id": "l_orderkey",
    "source_id": "CAST(l_suppkey AS STRING)",
    "priority": "l_linenumber",
    "seen_on": "CAST(l_shipdate AS DATE)",
}

TOGGLES_SQL = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "bucket": "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'favorites' ELSE 'hidden' END",
    "listing_id": "CAST(floor(value) AS BIGINT) % 20",
}
TOGGLES_WHERE = "event_type IN ('view', 'click', 'purchase')"

RUN_LOG_SQL = {
    "run_seq": "event_id",
    "finished_at": "ts",
    "source_id": "concat('u', CAST(user_id AS STRING))",
    "ok": "event_type <> 'error'",
}


def _project(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in cols.items()])


def sql_select(cols: dict[str, str], source: str, where: str | None = None) -> str:
    """The same projection as DuckDB/ANSI SQL text (used by the oracles)."""
    body = ",\n  ".join(f"{e} AS {n}" for n, e in cols.items())
    return f"SELECT {body}\nFROM {source}" + (f"\nWHERE {where}" if where else "")


def listings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spread(table(spark, sf_dir, "documents")), LISTINGS_SQL)


def deadlines_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), DEADLINES_SQL)


def sightings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), SIGHTINGS_SQL)


def toggles_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "events").where(TOGGLES_WHERE), TOGGLES_SQL)


def run_log_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), RUN_LOG_SQL)


def view_ctes() -> str:
    """``WITH`` clause defining the fixture views for DuckDB oracle SQL."""
    return (
        "WITH listings_v AS (" + sql_select(LISTINGS_SQL, "documents") + "),\n"
        "deadlines_v AS (" + sql_select(DEADLINES_SQL, "orders") + "),\n"
        "sightings_v AS (" + sql_select(SIGHTINGS_SQL, "lineitem") + "),\n"
        "toggles_v AS (" + sql_select(TOGGLES_SQL, "events", TOGGLES_WHERE) + "),\n"
        "run_log_v AS (" + sql_select(RUN_LOG_SQL, "events") + ")\n"
    )


# Latin test taxonomy built from frequent tokens of the driver documents; it
# mixes boundary-matched Latin keywords with substring-matched ones (accents,
# sharp s) and multi-word phrases.
LATIN_TAXONOMY = {
    "types": {
        "contest": {"keywords": ["anea", "eriner"]},
        "support": {"keywords": ["attion", "thanea"]},
        "hackathon": {"keywords": ["thanedble", "game jam"]},
        "event": {"keywords": ["that", "was"]},
        "education": {"keywords": ["der", "die"]},
        "supporters": {"keywords": ["que"]},
        "employment": {"keywords": ["ci", "los"]},
        "other": {"keywords": []},
    },
    "fields": {
        "game": ["the", "and"],
        "indie": ["of"],
        "ai": ["le", "la", "ai"],
        "software": ["und", "ein", "it"],
        "web_app": ["to", "is"],
        "data": ["des", "el"],
        "immersive": ["straße", "über"],
        "cloud_security": ["ment", "eux"],
        "startup": ["von", "zu"],
        "digital_content": ["in the", "of the"],
    },
    "audiences": {
        "university": ["with", "mit"],
        "youth": ["y", "sich"],
        "developer": ["é", "ç"],
        "startup": ["for"],
    },
    "exclude_phrases": ["was the", "ß"],
}


def listing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``listings_v`` as a raw listing batch (missing raw columns defaulted)."""
    from tidemark.operators.normalize import with_raw_defaults
    return with_raw_defaults(listings_v(spark, sf_dir))


def today_of(value: str) -> dt.date:
    return dt.date.fromisoformat(value)


# Previous snapshot: listings_v minus every fifth row, with a changed title and
# a changed post id on every seventh row, first seen on the previous run.
PREVIOUS_SQL = dict(LISTINGS_SQL)
PREVIOUS_SQL["title"] = ("CASE WHEN doc_id % 7 = 0 THEN concat(split_part(text, chr(10), 1), ' (prev)') "
                         "ELSE split_part(text, chr(10), 1) END")
PREVIOUS_SQL["source_post_id"] = ("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN concat(CAST(doc_id AS STRING), 'p') "
                                  "ELSE CAST(doc_id AS STRING) END")
PREVIOUS_WHERE = "doc_id % 5 <> 0"
PREVIOUS_TODAY = "2024-01-20"


def previous_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.normalize import with_raw_defaults
    return with_raw_defaults(_project(spread(table(spark, sf_dir, "documents")).where(PREVIOUS_WHERE), PREVIOUS_SQL))


def previous_view_sql() -> str:
    return sql_select(PREVIOUS_SQL, "documents", PREVIOUS_WHERE).replace("AS STRING", "AS VARCHAR")
