"""Facet counts (Q7, Q8, Q9, Q12) as a stored cube.

The cube counts listings by dataset, primary type, adjacency, status, field tag
and quick tag. A listing has one of each of the first four and any number of
tags, so tags are exploded together with a marker for "any"; the other three are
rolled up by GROUPING SETS. Every combination of filters of the query layer, but
for search, is then one row per adjacency.

Listings are counted by their distinct combinations first (with partial
aggregation), so what is exploded and rolled up has as many rows as there are
combinations, however many listings.

:func:`update_cube` brings a cube from one run to the next by adding the
difference: listings whose combination is new count 1, those whose combination is
gone count -1, all others cancel out before anything is exploded.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import taxonomy as tx
from tidemark.operators.query import quick_tag_match

ANY = "*"
ROLLED = ("dataset", "primary_type", "status")
DIMS = ("dataset", "primary_type", "is_adjacent", "status", "field", "quick")
CELL = ("dataset", "primary_type", "is_adjacent", "status", "fields", "quicks")


def quick_tags(now: Column) -> Column:
    """The quick tags that a listing matches at ``now``."""
    cols = [F.col(c) for c in ("first_seen_ts", "last_changed_ts", "d_day", "field_tags", "audience_tags")]
    tags = F.array(*[F.when(quick_tag_match(t, *cols, now), F.lit(t)) for t in tx.QUICK_TAGS])
    return F.array_compact(tags)


def cells(listings: DataFrame, now: Column) -> DataFrame:
    """The listings' columns that the cube counts by (null dataset: unrouted)."""
    none = F.array().cast("array<string>")
    return listings.withColumns({
        "dataset": F.coalesce("dataset", F.lit("")), "status": F.coalesce("status", F.lit("")), "primary_type": F.coalesce("primary_type", F.lit("")),
        "is_adjacent": F.coalesce("is_adjacent", F.lit(False)),
        "fields": F.array_sort(F.array_distinct(F.coalesce("field_tags", none))), "quicks": quick_tags(now)})


def _roll_up(counted: DataFrame) -> DataFrame:
    """The cube of (CELL, n)."""
    anything = F.array(F.lit(ANY))
    spread = (counted.withColumn("field", F.explode(F.concat("fields", anything)))
              .withColumn("quick", F.explode(F.concat("quicks", anything))))
    always = [c for c in DIMS if c not in ROLLED]
    sets = [[*always, *(c for k, c in enumerate(ROLLED) if mask >> k & 1)] for mask in range(1 << len(ROLLED))]
    summed = spread.groupingSets([[F.col(c) for c in s] for s in sets], *DIMS).agg(
        F.sum("n").alias("n"), *[F.grouping(c).alias(f"_all_{c}") for c in ROLLED])
    named = {c: F.when(F.col(f"_all_{c}") == 1, F.lit(ANY)).otherwise(F.col(c)) for c in ROLLED}
    return summed.withColumns(named).select(*DIMS, "n")


def facet_cube(listings: DataFrame, now: Column) -> DataFrame:
    """(DIMS, n) of all listings at ``now``; ``*`` stands for any value."""
    return _roll_up(cells(listings, now).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")))


def update_cube(cube: DataFrame, before: DataFrame, before_now: Column, after: DataFrame, after_now: Column, key: str = "id") -> DataFrame:
    """The cube of ``after``, from that of ``before`` and the listings whose
    combination differs (``cube`` as :func:`facet_cube` made it at ``before_now``)."""
    side = lambda df, now, sign: cells(df, now).select(key, *CELL, F.lit(sign).cast("long").alias("n"))
    both = side(before, before_now, -1).unionByName(side(after, after_now, 1))
    moved = both.groupBy(key, *CELL).agg(F.sum("n").alias("n")).where("n <> 0").groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")
    return cube.unionByName(_roll_up(moved)).groupBy(*DIMS).agg(F.sum("n").alias("n")).where("n <> 0")


def cells_for(cube: DataFrame, *, dataset: str = ANY, type: str | None = "all", status: str = "", field: str = "", quick: str = "") -> DataFrame:
    """The cube's rows for a set of filters; an empty filter means any, and the
    type ``all`` leaves adjacent listings out (None keeps them)."""
    out = cube.where((F.col("dataset") == dataset) & (F.col("status") == (status or ANY))
                     & (F.col("field") == (field or ANY)) & (F.col("quick") == (quick or ANY)))
    if type is None:
        return out.where(F.col("primary_type") == ANY)
    if type == "all":
        return out.where((F.col("primary_type") == ANY) & ~F.col("is_adjacent"))
    return out.where(F.col("primary_type") == type)
