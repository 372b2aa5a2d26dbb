"""Personal state as a toggle log.

Membership of (user, bucket, listing) is the parity of its toggles; a restore
event clears a user's hidden bucket (toggles before the latest restore are
ignored). Everything is a grouped aggregate keyed by user, so a very active
user is pre-aggregated map-side before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def toggle_state(toggles: DataFrame, restores: DataFrame | None = None) -> DataFrame:
    """U1 (+U4): (user_id, bucket, listing_id) currently set.

    ``toggles``: (user_id, bucket, listing_id, ts); ``restores``: (user_id, ts)
    events that empty the hidden bucket.
    """
    t = toggles
    if restores is not None:
        last = restores.groupBy("user_id").agg(F.max("ts").alias("__reset"))
        t = t.join(last, "user_id", "left").where(
            (F.col("bucket") != "hidden") | F.col("__reset").isNull() | (F.col("ts") > F.col("__reset"))).drop("__reset")
    agg = t.groupBy("user_id", "bucket", "listing_id").agg(F.count(F.lit(1)).alias("__n"))
    return agg.where(F.col("__n") % 2 == 1).drop("__n")


def hide(listings: DataFrame, state: DataFrame, user_id: int, key: str = "listing_id") -> DataFrame:
    """Listings minus the user's hidden ones."""
    hidden = state.where((F.col("user_id") == user_id) & (F.col("bucket") == "hidden")).select(F.col("listing_id").alias(key))
    return listings.join(hidden, key, "left_anti")


def flags(listings: DataFrame, state: DataFrame, user_id: int, key: str = "listing_id") -> DataFrame:
    """Favorite / read flags per row for one user."""
    mine = state.where(F.col("user_id") == user_id)
    pivot = mine.groupBy(F.col("listing_id").alias(key)).agg(
        F.max(F.col("bucket") == "favorites").alias("is_favorite"), F.max(F.col("bucket") == "read").alias("is_read"))
    out = listings.join(pivot, key, "left")
    return out.withColumns({"is_favorite": F.coalesce("is_favorite", F.lit(False)), "is_read": F.coalesce("is_read", F.lit(False))})


STATE_SCHEMA = "struct<version:int,favorites:array<string>,read:array<string>,hidden:array<string>>"


def load_state(raw_json: DataFrame, col: str = "value") -> DataFrame:
    """Tolerant load; a bad version or shape gives empty buckets."""
    parsed = F.from_json(F.col(col), STATE_SCHEMA, {"mode": "PERMISSIVE"})
    ok = parsed.isNotNull() & (parsed["version"] == 1)
    empty = F.array().cast("array<string>")
    return raw_json.select("*", *[F.when(ok, F.coalesce(parsed[b], empty)).otherwise(empty).alias(b) for b in ("favorites", "read", "hidden")])
