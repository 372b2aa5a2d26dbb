"""Record shapes: raw listing, source record, canonical listing, run status.
Column names, types and defaults are fixed values: the stored records have them."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import types as T

from tidemark.config import taxonomy as tx
from tidemark.functions.shapes import Flag, Items, Record, Text, Whole

# Raw listing columns with (type, default). Text defaults are '', URLs and
# dates null, kind 'aggregate', priority 40, date kind and fee 'unknown'.
RAW_DEFAULTS = {
    "source_id": ("string", None),
    "source_name": ("string", None),
    "source_url": ("string", None),
    "title": ("string", None),
    "organizer": ("string", ""),
    "summary": ("string", ""),
    "body_text": ("string", ""),
    "source_post_id": ("string", None),
    "source_kind": ("string", "aggregate"),
    "source_priority": ("int", 40),
    "application_url": ("string", None),
    "document_url": ("string", None),
    "recruit_start": ("string", None),
    "recruit_end": ("string", None),
    "event_start": ("string", None),
    "event_end": ("string", None),
    "date_kind": ("string", "unknown"),
    "eligibility": ("string", ""),
    "benefits": ("string", ""),
    "location": ("string", ""),
    "mode": ("string", ""),
    "fee": ("string", "unknown"),
    "original_category": ("string", ""),
    "collected_at": ("string", None),
}

SOURCE_STRUCT = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("source_post_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("fetched_at", T.StringType()),
])

RELEVANCE_STRUCT = T.StructType([
    T.StructField("score", T.IntegerType()),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("decision", T.StringType()),
])

LISTING_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("organizer", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("primary_type", T.StringType()),
    T.StructField("field_tags", T.ArrayType(T.StringType())),
    T.StructField("audience_tags", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("relevance", RELEVANCE_STRUCT),
    T.StructField("first_seen_at", T.StringType()),
    T.StructField("last_seen_at", T.StringType()),
    T.StructField("sources", T.ArrayType(SOURCE_STRUCT)),
    T.StructField("application_url", T.StringType()),
    T.StructField("document_url", T.StringType()),
    T.StructField("recruit_start", T.StringType()),
    T.StructField("recruit_end", T.StringType()),
    T.StructField("event_start", T.StringType()),
    T.StructField("event_end", T.StringType()),
    T.StructField("date_kind", T.StringType()),
    T.StructField("d_day", T.IntegerType()),
    T.StructField("eligibility", T.StringType()),
    T.StructField("benefits", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("fee", T.StringType()),
    T.StructField("is_adjacent", T.BooleanType()),
    T.StructField("last_changed_at", T.StringType()),
    T.StructField("change_flags", T.ArrayType(T.StringType())),
    T.StructField("is_manual_reviewed", T.BooleanType()),
    T.StructField("dedupe_key", T.StringType()),
])
LISTING_COLUMNS = [f.name for f in LISTING_SCHEMA.fields]
REQUIRED_LISTING = ("id", "title", "source_name", "source_url", "organizer", "summary", "primary_type",
                    "field_tags", "audience_tags", "status", "relevance", "first_seen_at", "last_seen_at")

# ---- shapes of stored records (see functions/shapes.py)
SOURCE_SHAPE = Record({
    "source_id": Text(), "source_name": Text(), "source_url": Text(), "source_post_id": Text(null=True),
    "kind": Text(null=True), "priority": Whole(null=True), "fetched_at": Text(null=True),
}, required=("source_id", "source_name", "source_url"))
RELEVANCE_SHAPE = Record({"score": Whole(), "reasons": Items(Text()), "decision": Text()}, required=("score", "reasons", "decision"))
_NESTED = {"relevance": RELEVANCE_SHAPE, "sources": Items(SOURCE_SHAPE)}


def _shape_of(f: T.StructField) -> object:
    free = f.name not in REQUIRED_LISTING
    if f.name in _NESTED:
        return _NESTED[f.name]
    if isinstance(f.dataType, T.ArrayType):
        return Items(Text(), null=free)
    return {T.StringType: Text, T.IntegerType: Whole, T.BooleanType: Flag}[type(f.dataType)](null=free)


# V6: a record converts if it has these keys and no others, at every level.
LISTING_SHAPE = Record({f.name: _shape_of(f) for f in LISTING_SCHEMA.fields}, required=REQUIRED_LISTING)
# Re-reading drops unknown keys of the record itself, not those inside it.
REREAD_SHAPE = replace(LISTING_SHAPE, closed=False)
# The published schema; further keys may occur.
PUBLISHED_SHAPE = Record({
    "id": Text(least=8), "title": Text(least=1), "source_name": Text(), "source_url": Text(), "organizer": Text(least=1),
    "summary": Text(least=60, most=180), "status": Text(among=tx.STATUSES), "date_kind": Text(among=tx.DATE_KINDS),
    "primary_type": Text(among=tx.TYPES), "field_tags": Items(Text()), "audience_tags": Items(Text()),
    "first_seen_at": Text(), "last_seen_at": Text(),
    "sources": Items(Record({"source_id": Text(least=1), "source_name": Text(least=1), "source_url": Text(), "kind": Text(least=1), "priority": Whole()},
                            required=("source_id", "source_name", "source_url", "kind", "priority"), closed=False), least=1),
    "relevance": Record({"score": Whole(least=0, most=100), "reasons": Items(Text()), "decision": Text(among=("publish", "review", "exclude"))},
                        required=("score", "reasons", "decision"), closed=False),
}, required=("id", "title", "source_name", "source_url", "organizer", "status", "summary", "primary_type", "field_tags", "audience_tags",
             "first_seen_at", "last_seen_at", "sources", "date_kind", "relevance"), closed=False)

RUN_STATUS_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("finished_at", T.StringType()),
    T.StructField("collected_count", T.LongType()),
    T.StructField("published_count", T.LongType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("new_count", T.LongType()),
    T.StructField("changed_count", T.LongType()),
    T.StructField("consecutive_failures", T.LongType()),
    T.StructField("last_success_at", T.StringType()),
    T.StructField("error", T.StringType()),
])

# Fields whose change marks a listing as updated (fixed order).
IMPORTANT_FIELDS = (
    "title", "organizer", "recruit_start", "recruit_end", "event_start", "event_end", "date_kind",
    "eligibility", "benefits", "location", "mode", "application_url", "document_url",
)
# Fields a manual row or patch may set (fixed set).
ALLOWED_PATCH_FIELDS = (
    "title", "organizer", "summary", "application_url", "document_url", "recruit_start",
    "recruit_end", "event_start", "event_end", "date_kind", "eligibility", "benefits",
    "location", "mode", "fee", "primary_type", "field_tags", "audience_tags", "is_adjacent",
)
