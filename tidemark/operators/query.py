"""Faceted query layer over a published dataset (Q1-Q15).

Filters compose into one predicate that Catalyst pushes into the scan; facet
counts are conditional aggregates in a single pass; sorts and pages use a
window with a total order (primary key tie-break).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import taxonomy as tx
from tidemark.operators.ordering import global_positions, top_page

HOUR_SECONDS = 3600


@dataclass(frozen=True)
class Filters:
    type: str = "all"
    quick: str = ""
    search: str = ""
    field: str = ""
    status: str = ""


def _ts(col: Column) -> Column:
    """ISO timestamp string (with offset) or timestamp column -> instant."""
    return col if not isinstance(col, str) else F.col(col)


def is_new(first_seen: Column, now: Column) -> Column:
    """Q3: first seen at most 72 h before now (future counts). Both sides must
    share a type (zoned or local timestamps)."""
    return F.coalesce(first_seen >= now - F.expr("INTERVAL 72 HOURS"), F.lit(False))


def is_updated(last_changed: Column, now: Column) -> Column:
    """Q4: changed at most 48 h before now; never when unset."""
    return F.coalesce(last_changed >= now - F.expr("INTERVAL 48 HOURS"), F.lit(False))


def deadline_soon(d_day: Column) -> Column:
    """Q5: d_day in 0..7."""
    return F.coalesce(d_day.between(0, 7), F.lit(False))


def quick_tag_match(tag: str, first_seen: Column, last_changed: Column, d_day: Column, field_tags: Column, audience_tags: Column, now: Column) -> Column:
    """Q6: NEW / UPDATED / deadline-soon, else membership in field or audience tags."""
    new_tag, upd_tag, soon_tag = tx.QUICK_TAGS[3], tx.QUICK_TAGS[4], tx.QUICK_TAGS[5]
    if tag == new_tag:
        return is_new(first_seen, now)
    if tag == upd_tag:
        return is_updated(last_changed, now)
    if tag == soon_tag:
        return deadline_soon(d_day)
    return F.coalesce(F.array_contains(field_tags, tag) | F.array_contains(audience_tags, tag), F.lit(False))


def search_terms(search: str) -> list[str]:
    return [t for t in search.strip().lower().split() if t]


def search_match(terms: list[str], haystack: Column) -> Column:
    """Q2: every term is a substring of the lower-cased haystack."""
    out = F.lit(True)
    low = F.lower(haystack)
    for t in terms:
        out = out & low.contains(t)
    return out


def listing_haystack(df_cols: dict[str, Column]) -> Column:
    return F.concat_ws(" ", df_cols["title"], df_cols["organizer"], df_cols["summary"], df_cols["source_name"],
                       F.array_join(df_cols["field_tags"], " "), F.array_join(df_cols["audience_tags"], " "))


def filter_predicate(f: Filters, *, is_adjacent: Column, primary_type: Column, status: Column,
                     field_tags: Column, quick: Column | None = None, haystack: Column | None = None) -> Column:
    """Q1: adjacent rule (only while type is 'all'), type, quick tag, field tag,
    status, search; all optional and conjunctive."""
    pred = F.lit(True)
    if f.type == "all":
        pred = pred & ~F.coalesce(is_adjacent, F.lit(False))
    else:
        pred = pred & (primary_type == f.type)
    if f.quick and quick is not None:
        pred = pred & quick
    if f.field:
        pred = pred & F.coalesce(F.array_contains(field_tags, f.field), F.lit(False))
    if f.status:
        pred = pred & (status == f.status)
    terms = search_terms(f.search)
    if terms and haystack is not None:
        pred = pred & search_match(terms, haystack)
    return pred


def sort_order(mode: str, key: str, *, d_day: str = "d_day", first_seen: str = "first_seen_at",
               last_changed: str = "last_changed_at", last_seen: str = "last_seen_at", score: str = "score") -> list[Column]:
    """Q10: deadline asc (null 99999), newest desc, updated desc (last change
    else last seen), relevance desc; ties by ``key`` (stable order)."""
    if mode == "newest":
        first = F.col(first_seen).desc()
    elif mode == "updated":
        first = F.coalesce(F.col(last_changed), F.col(last_seen)).desc()
    elif mode == "relevance":
        first = F.col(score).desc()
    else:
        first = F.coalesce(F.col(d_day), F.lit(99999)).asc()
    return [first, F.col(key).asc()]


def sort_rank(df: DataFrame, mode: str, key: str, **cols) -> DataFrame:
    """Q10 with a distributed global position column ``pos``."""
    return global_positions(df, sort_order(mode, key, **cols), "pos")


def page_slice(df: DataFrame, order: list[Column], page: int, page_size: int = tx.PAGE_SIZE) -> DataFrame:
    """Q11: one page (50 rows by default), page clamped to 1..total pages."""
    rows, eff, pages = top_page(df, order, page, page_size)
    return rows.withColumns({"page": F.lit(eff), "total_pages": F.lit(pages)})


def d_day_label(status: Column, d_day: Column) -> Column:
    """Q14: display label for the deadline."""
    return (F.when(status == "ongoing", F.lit(tx.D_DAY_ONGOING))
            .when(status == "unknown", F.lit(tx.D_DAY_UNKNOWN))
            .when(status == "today", F.lit(tx.D_DAY_TODAY))
            .when(d_day.isNull(), F.lit(tx.D_DAY_NONE))
            .when(d_day < 0, F.concat(F.lit("D+"), F.abs(d_day).cast("string")))
            .otherwise(F.concat(F.lit("D-"), d_day.cast("string"))))


def label_map(mapping: dict[str, str], col: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v)))
    return out.otherwise(col)
