"""Normalisation of raw listings into the canonical listing shape.

One projection per stage, all JVM expressions: canonical URL, stable id,
summary contract, organizer/title cleanup, dedupe key, taxonomy scores and
deadline status.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import taxonomy as tx
from tidemark.functions.dates import status_for
from tidemark.functions.text import collapse_ws, match_key, strip_title_markers
from tidemark.functions.url import canonical_url
from tidemark.operators.classify import classify
from tidemark.schema import LISTING_COLUMNS, RAW_DEFAULTS, SOURCE_STRUCT


def with_raw_defaults(df: DataFrame) -> DataFrame:
    """Add any missing raw column with its default (text '' / null / 'unknown')."""
    missing = {}
    for name, (dtype, default) in RAW_DEFAULTS.items():
        if name not in df.columns:
            missing[name] = F.lit(default).cast(dtype)
    return df.withColumns(missing) if missing else df


def blank_to_null(col: Column) -> Column:
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(None).cast("string")).otherwise(col)


def stable_id(source_id: Column, post_id: Column, source_url: Column) -> Column:
    """First 20 hex chars of SHA-256 over ``source:postid-or-url``."""
    ident = F.concat(F.coalesce(source_id, F.lit("")), F.lit(":"), F.coalesce(blank_to_null(post_id), canonical_url(source_url)))
    return F.substring(F.sha2(ident, 256), 1, 20)


def summarize(summary: Column, title: Column, eligibility: Column, benefits: Column) -> Column:
    """Default when blank or equal to the title, padded while shorter than
    60 characters, cut at 180."""
    value = collapse_ws(F.coalesce(summary, F.lit("")))
    value = F.when((value == "") | (value == F.coalesce(title, F.lit(""))), F.lit(tx.SUMMARY_DEFAULT)).otherwise(value)
    prefix = F.coalesce(blank_to_null(eligibility), blank_to_null(benefits))
    value = F.when((F.length(value) < 60) & prefix.isNotNull(), F.concat(value, F.lit(". "), prefix)).otherwise(value)
    value = F.when(F.length(value) < 60, F.concat(value, F.lit(". " + tx.SUMMARY_PADDING))).otherwise(value)
    return F.substring(value, 1, 180)


def clean_organizer(organizer: Column, source_name: Column) -> Column:
    """Collapsed organizer, else the source name."""
    value = collapse_ws(F.coalesce(organizer, F.lit("")))
    return F.when(value == "", source_name).otherwise(value)


def dedupe_key(raw_title: Column, organizer: Column, recruit_end: Column) -> Column:
    """Match keys of the uncleaned title and the cleaned organizer plus the end date."""
    return F.concat_ws("|", match_key(raw_title), match_key(organizer), F.coalesce(recruit_end, F.lit("")))


def normalize(raw: DataFrame, taxonomy: dict, now_iso: str, today: str) -> DataFrame:
    """Raw listings -> canonical listings (plus ``ingest_seq`` carried through).

    ``now_iso`` is the run stamp (ISO, seconds, with offset), ``today`` the run's
    local calendar date.
    """
    df = with_raw_defaults(raw)
    scored = classify(df, taxonomy)
    status, d_day = status_for(F.col("recruit_start"), F.col("recruit_end"), F.col("date_kind"), F.lit(today).cast("date"))
    stamp = F.coalesce(F.col("collected_at"), F.lit(now_iso))
    url = canonical_url(F.col("source_url"))
    org = clean_organizer(F.col("organizer"), F.col("source_name"))
    staged = scored.withColumns({"__url": url, "__org": org, "__stamp": stamp})
    out = staged.select(
        F.col("ingest_seq"),
        stable_id(F.col("source_id"), F.col("source_post_id"), F.col("source_url")).alias("id"),
        strip_title_markers(F.col("title")).alias("title"),
        F.col("source_name"),
        F.col("__url").alias("source_url"),
        F.col("__org").alias("organizer"),
        summarize(F.col("summary"), F.col("title"), F.col("eligibility"), F.col("benefits")).alias("summary"),
        F.col("primary_type"),
        F.col("field_tags"),
        F.col("audience_tags"),
        status.alias("status"),
        F.col("relevance"),
        F.col("__stamp").alias("first_seen_at"),
        F.col("__stamp").alias("last_seen_at"),
        F.array(F.struct(
            F.col("source_id"), F.col("source_name"), F.col("__url").alias("source_url"),
            F.col("source_post_id"), F.col("source_kind").alias("kind"),
            F.col("source_priority").cast("int").alias("priority"), F.col("__stamp").alias("fetched_at"),
        ).cast(SOURCE_STRUCT)).alias("sources"),
        F.when(F.coalesce(F.col("application_url"), F.lit("")) != "", canonical_url(F.col("application_url"))).alias("application_url"),
        F.when(F.coalesce(F.col("document_url"), F.lit("")) != "", canonical_url(F.col("document_url"))).alias("document_url"),
        F.col("recruit_start"), F.col("recruit_end"), F.col("event_start"), F.col("event_end"),
        F.col("date_kind"),
        d_day.alias("d_day"),
        F.substring(F.coalesce(F.col("eligibility"), F.lit("")), 1, 240).alias("eligibility"),
        F.substring(F.coalesce(F.col("benefits"), F.lit("")), 1, 240).alias("benefits"),
        F.substring(F.coalesce(F.col("location"), F.lit("")), 1, 120).alias("location"),
        F.coalesce(F.col("mode"), F.lit("")).alias("mode"),
        F.coalesce(F.col("fee"), F.lit("unknown")).alias("fee"),
        F.col("is_adjacent"),
        F.lit(None).cast("string").alias("last_changed_at"),
        F.array().cast("array<string>").alias("change_flags"),
        F.lit(False).alias("is_manual_reviewed"),
        dedupe_key(F.col("title"), F.col("__org"), F.col("recruit_end")).alias("dedupe_key"),
    )
    # Observed row count: also a plan boundary. Without it a later filter on
    # decision / status / dataset is pushed below the scoring projections and
    # every alias level multiplies the expression tree (megabytes of plan).
    return out.select("ingest_seq", *LISTING_COLUMNS).observe(f"normalized_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))
