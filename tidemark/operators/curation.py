"""Curation: manual rows, exclusions, field patches, forced decisions.

Curation config is small (a reviewer's file); it is broadcast after a size
check. Patch values travel as ``map<string,string>`` (JSON text per field) so
that "set to null" differs from "absent".
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import taxonomy as tx
from tidemark.functions.dates import status_for
from tidemark.operators.normalize import normalize
from tidemark.schema import ALLOWED_PATCH_FIELDS

BROADCAST_ROWS = 100_000
ARRAY_FIELDS = ("field_tags", "audience_tags")
BOOL_FIELDS = ("is_adjacent",)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table only after counting it: at most ``limit`` rows are
    hinted; beyond that the join is left to the planner (shuffle join)."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def exclude(items: DataFrame, ids: DataFrame, urls: DataFrame) -> DataFrame:
    """O2: drop by id or by representative URL (not other source URLs, T22)."""
    out = items.join(bounded_broadcast(ids.select(F.col("id").alias("id")).distinct()), "id", "left_anti")
    return out.join(bounded_broadcast(urls.select(F.col("source_url")).distinct()), "source_url", "left_anti")


def _typed(field: str, value: Column) -> Column:
    if field in ARRAY_FIELDS:
        return F.from_json(value, "array<string>")
    wrapped = F.concat(F.lit('{"v":'), value, F.lit("}"))
    if field in BOOL_FIELDS:
        return F.from_json(wrapped, "struct<v:boolean>")["v"]
    return F.from_json(wrapped, "struct<v:string>")["v"]


def resolve_targets(items: DataFrame, patches: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """O3 targeting: by id, else by any source URL; for both the last listing
    in order holding the key wins. Returns (patch_ord, target)."""
    by_id = items.groupBy("id").agg(F.max(seq).alias("t_id"))
    by_url = items.select(seq, F.explode(F.transform("sources", lambda s: s["source_url"])).alias("source_url")).groupBy("source_url").agg(F.max(seq).alias("t_url"))
    p = patches.select("patch_ord", "id", "source_url")
    p = p.join(by_id.join(p.select("id"), "id", "left_semi"), "id", "left").join(
        by_url.join(p.select("source_url"), "source_url", "left_semi"), "source_url", "left")
    return p.select("patch_ord", F.coalesce("t_id", "t_url").alias("target")).where(F.col("target").isNotNull())


def apply_patches(items: DataFrame, patches: DataFrame, today: str, seq: str = "ingest_seq") -> DataFrame:
    """O3 + O4: patches in file order; the last patch carrying a field sets it;
    status recomputed; force_publish then force_review per patch, in order.

    ``patches``: (patch_ord, id, source_url, fields map<string,string> of JSON
    values, force_publish bool, force_review bool).
    """
    targets = resolve_targets(items, patches, seq)
    tp = targets.join(patches.select("patch_ord", "fields", "force_publish", "force_review"), "patch_ord")
    agg_exprs = [F.max_by(F.col("fields")[f], F.when(F.map_contains_key("fields", f), F.col("patch_ord"))).alias("v_" + f) for f in ALLOWED_PATCH_FIELDS]
    agg_exprs += [F.max(F.map_contains_key("fields", f)).alias("has_" + f) for f in ALLOWED_PATCH_FIELDS]
    agg_exprs.append(F.array_sort(F.collect_list(F.struct("patch_ord", F.coalesce("force_publish", F.lit(False)).alias("fp"),
                                                          F.coalesce("force_review", F.lit(False)).alias("fr")))).alias("flags"))
    per = tp.groupBy(F.col("target").alias(seq)).agg(*agg_exprs)
    j = items.join(per, seq, "left")
    patched = F.col("flags").isNotNull()
    sets = {f: F.when(F.coalesce(F.col("has_" + f), F.lit(False)), _typed(f, F.col("v_" + f))).otherwise(F.col(f)) for f in ALLOWED_PATCH_FIELDS}
    j = j.withColumns(sets)
    status, d_day = status_for(F.col("recruit_start"), F.col("recruit_end"), F.col("date_kind"), F.lit(today).cast("date"))
    init = F.struct(F.col("relevance.score").alias("s"), F.col("relevance.decision").alias("d"), F.col("relevance.reasons").alias("r"))
    folded = F.aggregate(
        F.coalesce(F.col("flags"), F.array().cast("array<struct<patch_ord:bigint,fp:boolean,fr:boolean>>")), init,
        lambda acc, p: F.struct(
            F.when(p["fr"], F.least(F.lit(69), F.greatest(F.lit(50), F.when(p["fp"], F.greatest(F.lit(70), acc["s"])).otherwise(acc["s"]))))
             .when(p["fp"], F.greatest(F.lit(70), acc["s"])).otherwise(acc["s"]).alias("s"),
            F.when(p["fr"], F.lit("review")).when(p["fp"], F.lit("publish")).otherwise(acc["d"]).alias("d"),
            F.when(p["fp"], F.concat(acc["r"], F.array(F.lit(tx.REASON_MANUAL)))).otherwise(acc["r"]).alias("r"),
        ))
    out = j.withColumns({
        "status": F.when(patched, status).otherwise(F.col("status")),
        "d_day": F.when(patched, d_day).otherwise(F.col("d_day")),
        "relevance": F.struct(folded["s"].alias("score"), folded["r"].alias("reasons"), folded["d"].alias("decision")),
        "is_manual_reviewed": F.col("is_manual_reviewed") | patched,
    })
    return out.select(*items.columns)


MANUAL_PRIORITY = 120


def manual_items(manual: DataFrame, taxonomy: dict, now_iso: str, today: str) -> DataFrame:
    """O1: manual rows -> listings. ``manual`` holds raw-style columns plus
    ``fields`` (map of explicitly set allowed fields, JSON values),
    ``force_publish`` (default true), ``is_official`` and ``manual_ord``."""
    raw = manual.select(
        F.col("manual_ord").alias("ingest_seq"), F.lit("manual").alias("source_id"),
        F.coalesce(F.col("source_name"), F.lit(tx.MANUAL_SOURCE_NAME)).alias("source_name"),
        "source_url", F.col("id").alias("source_post_id"), "title",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("organizer", "summary", "body_text", "eligibility", "benefits", "location", "mode")],
        F.when(F.coalesce("is_official", F.lit(False)), F.lit("official")).otherwise(F.lit("aggregate")).alias("source_kind"),
        F.lit(MANUAL_PRIORITY).alias("source_priority"),
        "application_url", "document_url", "recruit_start", "recruit_end",
        F.coalesce(F.col("date_kind"), F.lit("unknown")).alias("date_kind"),
        F.coalesce(F.col("fee"), F.lit("unknown")).alias("fee"),
        F.lit(now_iso).alias("collected_at"),
    )
    norm = normalize(raw, taxonomy, now_iso, today)
    extra = manual.select(F.col("manual_ord").alias("ingest_seq"), "fields", F.coalesce("force_publish", F.lit(True)).alias("fp"))
    j = norm.join(bounded_broadcast(extra), "ingest_seq")
    sets = {f: F.when(F.map_contains_key("fields", f), _typed(f, F.col("fields")[f])).otherwise(F.col(f)) for f in ALLOWED_PATCH_FIELDS}
    j = j.withColumns(sets)
    status, d_day = status_for(F.col("recruit_start"), F.col("recruit_end"), F.col("date_kind"), F.lit(today).cast("date"))
    rel = F.when(F.col("fp"), F.struct(
        F.greatest(F.lit(70), F.col("relevance.score")).alias("score"),
        F.concat(F.col("relevance.reasons"), F.array(F.lit(tx.REASON_MANUAL))).alias("reasons"),
        F.lit("publish").alias("decision"))).otherwise(F.col("relevance"))
    out = j.withColumns({"status": status, "d_day": d_day, "relevance": rel, "is_manual_reviewed": F.lit(True)})
    return out.select(*norm.columns)


PATCH_SCHEMA = T.StructType([
    T.StructField("patch_ord", T.LongType()), T.StructField("id", T.StringType()), T.StructField("source_url", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("force_publish", T.BooleanType()), T.StructField("force_review", T.BooleanType()),
])
