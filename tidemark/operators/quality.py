"""Data-quality rules over published listings.

Each rule is a boolean column; failing rule names are collected per row and
exploded into a violations table (dataset, row, rule). V7 (id unique across
the four datasets, later occurrences flagged) is a window partitioned by id.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import SCHEMA_VERSION
from tidemark.config import taxonomy as tx
from tidemark.functions.shapes import Record, Whole, document_faults
from tidemark.functions.url import is_http_url
from tidemark.schema import LISTING_SHAPE, PUBLISHED_SHAPE
from tidemark.sources.snapshot import DATASETS, latest_manifest, read_lines

def dataset_ord():
    return F.when(F.col("dataset") == "active", 0).when(F.col("dataset") == "undated", 1).when(F.col("dataset") == "closed", 2).otherwise(3)


def _ts_ok(col):
    return F.try_to_timestamp(col).isNotNull()


def violations(df: DataFrame, row: str = "ingest_seq") -> DataFrame:
    """(dataset, row, rule) for every failed rule."""
    # V7: the first occurrence of each id in (dataset order, row) comes from a
    # grouped min (partially aggregated, so a heavily repeated id stays cheap).
    keyed = df.withColumn("__occ", F.struct(dataset_ord().alias("o"), F.col(row).alias("r")))
    firsts = keyed.groupBy("id").agg(F.min("__occ").alias("__first"))
    df = keyed.join(firsts, "id", "left")
    score = F.col("relevance.score")
    dec = F.col("relevance.decision")
    src_ok = F.forall("sources", lambda s: (F.coalesce(s["source_id"], F.lit("")) != "") & (F.coalesce(s["source_name"], F.lit("")) != "")
                      & (F.coalesce(s["source_url"], F.lit("")) != "") & is_http_url(s["source_url"]))
    rules = {
        "V7_duplicate_id": F.col("id").isNotNull() & (F.col("__occ") != F.col("__first")),
        "V8_title_or_url": (F.trim(F.coalesce("title", F.lit(""))) == "") | (F.coalesce("source_url", F.lit("")) == "") | ~is_http_url(F.col("source_url")),
        "V8_enums": ~F.col("primary_type").isin(*tx.TYPES) | ~F.col("status").isin(*tx.STATUSES) | ~F.col("date_kind").isin(*tx.DATE_KINDS),
        "V9_summary_length": ~F.length("summary").between(60, 180),
        "V10_sources": (F.size("sources") == 0) | ~src_ok,
        "V11_seen_times": (F.coalesce("first_seen_at", F.lit("")) == "") | ~_ts_ok(F.col("first_seen_at"))
        | (F.coalesce("last_seen_at", F.lit("")) == "") | ~_ts_ok(F.col("last_seen_at"))
        | ((F.coalesce("last_changed_at", F.lit("")) != "") & ~_ts_ok(F.col("last_changed_at"))),
        "V12_optional_urls": ~is_http_url(F.col("application_url")) | ~is_http_url(F.col("document_url")),
        "V13_score_decision": ((dec == "publish") & (score < 70)) | ((dec == "review") & ~score.between(50, 69)),
        "V14_schema_extras": (F.length("id") < 8) | ~score.between(0, 100) | (F.coalesce("organizer", F.lit("")) == ""),
    }
    flagged = df.select("dataset", F.col(row).alias("row"), F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()])).alias("failed"))
    return flagged.select("dataset", "row", F.explode("failed").alias("rule"))


def assert_valid(df: DataFrame, row: str = "ingest_seq") -> None:
    """Fail the run when any violation exists (a scalar count)."""
    n = violations(df, row).count()
    if n:
        raise ValueError(f"{n} data-quality violations")


def record_faults(lines: DataFrame, shape: Record, value: str = "value") -> DataFrame:
    """The columns of ``lines`` with (path, fault) for everything that
    is wrong with each JSON record, at every level of nesting."""
    rest = [c for c in lines.columns if c != value]
    return lines.select(*rest, F.inline(document_faults(shape, F.col(value))))


def payload_violations(spark, root: str) -> DataFrame:
    """V1-V6 and V14 over a written run (manifest + dataset partitions): (dataset,
    row, rule) for a missing dataset, a wrong schema version, an unparseable
    generated_at, unknown keys of the envelope, rows that do not convert and
    rows outside the published schema. All reads go through Spark."""
    schema_out = "dataset string, row long, rule string"
    manifest = latest_manifest(spark, root)
    if manifest is None:
        return spark.createDataFrame([(d, -1, "V1_missing") for d in DATASETS], schema_out)
    found: list[tuple[str, int, str]] = []
    if manifest.get("schema_version") != SCHEMA_VERSION:
        found.append(("manifest", -1, "V2_schema_version"))
    try:
        dt.datetime.fromisoformat(manifest["generated_at"])
    except (KeyError, TypeError, ValueError):
        found.append(("manifest", -1, "V3_generated_at"))
    lines = read_lines(spark, f"{root.rstrip('/')}/runs/{manifest['run']}")
    present = set() if lines is None else {r.dataset for r in lines.select("dataset").distinct().collect()}   # five values at most
    found += [(d, -1, "V1_missing") for d in manifest.get("datasets") or [] if d not in present]
    meta = spark.createDataFrame(found, schema_out)
    if lines is None:
        return meta
    stored = replace(LISTING_SHAPE, keys={**LISTING_SHAPE.keys, "rank": Whole(null=True)})
    row = F.coalesce(F.get_json_object("value", "$.rank").try_cast("long"), F.lit(-1))
    rules = F.array_compact(F.array(
        F.when(F.size(document_faults(stored, F.col("value"))) > 0, F.lit("V6_conversion")),
        F.when(F.size(document_faults(PUBLISHED_SHAPE, F.col("value"))) > 0, F.lit("V14_published_schema"))))
    return meta.unionByName(lines.select("dataset", row.alias("row"), F.explode(rules).alias("rule")))


def status_violations(statuses: DataFrame, row: str | None = None) -> DataFrame:
    """V5: each status row has a source id and a valid run state."""
    bad = (F.coalesce(F.col("source_id"), F.lit("")) == "") | ~F.coalesce(F.col("status"), F.lit("")).isin(*tx.RUN_STATES)
    at = F.monotonically_increasing_id() if row is None else F.col(row).cast("long")
    return statuses.where(bad).select(F.lit("sources").alias("dataset"), at.alias("row"), F.lit("V5_status").alias("rule"))
