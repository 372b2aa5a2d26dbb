"""Query-layer, personal-state, health and run-bookkeeping queries
(Q*, U*, G*, R1-R4, S3, S4, S6)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.config import taxonomy as tx
from tidemark.operators import facets, health, personal, query
from tidemark.operators.query import Filters
from tidemark.plans import sqlgen as sg
from tidemark.plans.catalog import register
from tidemark.plans.q_listings import NORM, NORM_CTES, normalized
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import fixtures as fx
from tidemark.sources import published
from tidemark.sources.tables import table

def now_ts():
    return F.to_timestamp(F.lit(fx.NOW_ISO))


def now_ntz():
    return F.lit(fx.NOW_LOCAL).cast("timestamp_ntz")
USER = 7


_RUNS: dict[tuple[str, str], str] = {}


def run_of(spark, sf) -> published.PublishedRun:
    """The published run of the listings: written by the first query of an
    application that reads it, opened by all later ones."""
    at = (spark.sparkContext.applicationId, sf.rstrip("/"))
    run = published.open_published(spark, _RUNS[at]) if at in _RUNS else None
    if run is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/published/{uuid.uuid4().hex}"
        run = published.write_published(published.flat(normalized(spark, sf), fx.LISTING_TODAY), path, now_ts())
        _RUNS[at] = path
    return run


def scored(spark, sf):
    """Stored listings with their dataset (P1; null: not published) and flat columns."""
    return run_of(spark, sf).listings()


SCORED_SQL = f"""
WITH {NORM_CTES},
sc AS (
  SELECT *, title_c AS title, organizer_c AS organizer, summary_c AS summary,
    CASE WHEN decision = 'review' THEN 'review' WHEN decision <> 'publish' THEN NULL
         WHEN status = 'closed' THEN CASE WHEN {sg.iso_date('recruit_end')} >= DATE '2023-10-31' THEN 'closed' END
         WHEN status = 'unknown' THEN 'undated' ELSE 'active' END AS dataset,
    CAST(first_seen_at AS TIMESTAMPTZ) AS first_seen_ts, CAST(NULL AS TIMESTAMPTZ) AS last_changed_ts
  FROM {NORM}
)
"""
NOW_SQL = f"CAST('{fx.NOW_ISO}' AS TIMESTAMPTZ)"


def _quick(df, tag):
    return query.quick_tag_match(tag, F.col("first_seen_ts"), F.col("last_changed_ts"), F.col("d_day"), F.col("field_tags"), F.col("audience_tags"), now_ts())


def _pred(df, f: Filters):
    """All filters but search, which the trigram index answers."""
    return query.filter_predicate(f, is_adjacent=F.col("is_adjacent"), primary_type=F.col("primary_type"), status=F.col("status"),
                                  field_tags=F.col("field_tags"), quick=_quick(df, f.quick) if f.quick else None)


def _sql_quick(tag: str) -> str:
    if tag == "NEW":
        return f"coalesce(first_seen_ts >= {NOW_SQL} - INTERVAL 72 HOUR, false)"
    if tag == "UPDATED":
        return f"coalesce(last_changed_ts >= {NOW_SQL} - INTERVAL 48 HOUR, false)"
    if tag == tx.QUICK_TAGS[5]:
        return "coalesce(d_day BETWEEN 0 AND 7, false)"
    return f"coalesce(list_contains(field_tags, {sg.q(tag)}) OR list_contains(audience_tags, {sg.q(tag)}), false)"


HAYSTACK_SQL = "lower(concat_ws(' ', title, organizer, summary, source_name, array_to_string(field_tags, ' '), array_to_string(audience_tags, ' ')))"


def _sql_pred(f: Filters) -> str:
    parts = ["NOT coalesce(is_adjacent, false)" if f.type == "all" else f"primary_type = {sg.q(f.type)}"]
    if f.quick:
        parts.append(_sql_quick(f.quick))
    if f.field:
        parts.append(f"coalesce(list_contains(field_tags, {sg.q(f.field)}), false)")
    if f.status:
        parts.append(f"status = {sg.q(f.status)}")
    for t in query.search_terms(f.search):
        parts.append(f"contains({HAYSTACK_SQL}, {sg.q(t)})")
    return " AND ".join(parts)


F_FILTER = Filters(type="all", quick="AI", field="게임", status="open")
F_SEARCH = Filters(search="  The AND ")
F_SHORT = Filters(search=f" {tx.FIELD_LABELS['game']} q ")
F_TABS = Filters(search="the", field="게임")
F_QUICK = Filters(status="open")


@register("filter_listings", SCORED_SQL + f"SELECT ingest_seq, id, primary_type, status FROM sc WHERE {_sql_pred(F_FILTER)}")
def q_filter_listings(spark, sf):
    s = scored(spark, sf)
    return s.where(_pred(s, F_FILTER)).select("ingest_seq", "id", "primary_type", "status")


@register("search_terms", SCORED_SQL + f"SELECT ingest_seq, title FROM sc WHERE {_sql_pred(F_SEARCH)}")
def q_search_terms(spark, sf):
    """Q2 by the trigram index: rarest grams, intersection by count, then whole haystacks."""
    s = run_of(spark, sf).matching(query.search_terms(F_SEARCH.search))
    return s.where(_pred(s, F_SEARCH)).select("ingest_seq", "title")


@register("search_short_terms", SCORED_SQL + f"SELECT ingest_seq, title FROM sc WHERE {_sql_pred(F_SHORT)}")
def q_search_short_terms(spark, sf):
    """Q2 with terms of one and two characters: prefixes of the gram dictionary."""
    s = run_of(spark, sf).matching(query.search_terms(F_SHORT.search))
    return s.where(_pred(s, F_SHORT)).select("ingest_seq", "title")


@register("quick_tag", SCORED_SQL + "SELECT ingest_seq, " + ", ".join(
    f"{_sql_quick(t)} AS q{i}" for i, t in enumerate(tx.QUICK_TAGS)) + " FROM sc")
def q_quick_tag(spark, sf):
    s = scored(spark, sf)
    return s.select("ingest_seq", *[_quick(s, t).alias(f"q{i}") for i, t in enumerate(tx.QUICK_TAGS)])


@register("type_tab_counts", SCORED_SQL + "SELECT " + ", ".join(
    [f"CAST(count_if({_sql_pred(Filters(type='all', quick=F_TABS.quick, search=F_TABS.search, field=F_TABS.field, status=F_TABS.status))}) AS BIGINT) AS n_all"]
    + [f"CAST(count_if({_sql_pred(Filters(type=t, quick=F_TABS.quick, search=F_TABS.search, field=F_TABS.field, status=F_TABS.status))}) AS BIGINT) AS n_{t}" for t in tx.TYPES]) + " FROM sc")
def q_type_tab_counts(spark, sf):
    """Q7 under a search: one conditional aggregate for the 'all' tab and the
    eight types over the listings that the index finds."""
    s = run_of(spark, sf).matching(query.search_terms(F_TABS.search))

    def cnt(t):
        f = Filters(type=t, quick=F_TABS.quick, field=F_TABS.field, status=F_TABS.status)
        return F.count_if(_pred(s, f)).cast("bigint").alias(f"n_{t}")
    return s.agg(cnt("all"), *[cnt(t) for t in tx.TYPES])


@register("quick_tag_counts", SCORED_SQL + "SELECT " + ", ".join(
    f"CAST(count_if({_sql_pred(Filters(type=F_QUICK.type, quick=t, search=F_QUICK.search, field=F_QUICK.field, status=F_QUICK.status))}) AS BIGINT) AS n_q{i}"
    for i, t in enumerate(tx.QUICK_TAGS)) + " FROM sc")
def q_quick_tag_counts(spark, sf):
    """Q8: quick-tag counts under the other filters, from the cube."""
    c = facets.cells_for(run_of(spark, sf).cube().withColumn("tag", F.col("quick")).withColumn("quick", F.lit(facets.ANY)),
                         type=F_QUICK.type, field=F_QUICK.field, status=F_QUICK.status)
    return c.agg(*[_cube_sum(F.col("tag") == t).alias(f"n_q{i}") for i, t in enumerate(tx.QUICK_TAGS)])


def _cube_sum(cond):
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")


F_FACET = Filters(field=F_TABS.field)


@register("type_tab_facets", SCORED_SQL + "SELECT " + ", ".join(
    [f"CAST(count_if({_sql_pred(Filters(type=t, field=F_FACET.field))}) AS BIGINT) AS n_{t}" for t in ("all", *tx.TYPES)]) + " FROM sc")
def q_type_tab_facets(spark, sf):
    """Q7 without a search: tab counts from the cube."""
    c = run_of(spark, sf).cube()
    c = c.where((F.col("dataset") == facets.ANY) & (F.col("status") == facets.ANY) & (F.col("field") == F_FACET.field) & (F.col("quick") == facets.ANY))
    return c.agg(_cube_sum((F.col("primary_type") == facets.ANY) & ~F.col("is_adjacent")).alias("n_all"),
                 *[_cube_sum(F.col("primary_type") == t).alias(f"n_{t}") for t in tx.TYPES])


@register("field_facet", SCORED_SQL + "SELECT DISTINCT unnest(field_tags) AS field FROM sc")
def q_field_facet(spark, sf):
    """Q9: distinct field tags (sorted on output), from the cube."""
    c = run_of(spark, sf).cube().where((F.col("dataset") == facets.ANY) & (F.col("primary_type") == facets.ANY) & (F.col("status") == facets.ANY)
                                       & (F.col("quick") == facets.ANY) & (F.col("field") != facets.ANY))
    return c.select("field").distinct().orderBy("field")


def _cube_sql(rel: str, cols: str = "") -> str:
    """The facet cube of a relation with the columns of ``sc``."""
    quicks = "list_filter([" + ", ".join(f"CASE WHEN {_sql_quick(t)} THEN {sg.q(t)} END" for t in tx.QUICK_TAGS) + "], lambda x: x IS NOT NULL)"
    roll = ", ".join(f"CASE WHEN grouping({c}) = 1 THEN '*' ELSE {c} END AS {c}" for c in facets.ROLLED)
    return f"""
, cube_rows AS (
  SELECT coalesce(dataset, '') AS dataset, primary_type, coalesce(is_adjacent, false) AS is_adjacent, status,
         list_distinct(field_tags) AS fields, {quicks} AS quicks FROM {rel}
), cube_fields AS (SELECT * EXCLUDE (fields), unnest(list_append(fields, '*')) AS field FROM cube_rows),
cube_tags AS (SELECT * EXCLUDE (quicks), unnest(list_append(quicks, '*')) AS quick FROM cube_fields)
SELECT {roll}, is_adjacent, field, quick, CAST(count(*) AS BIGINT) AS n FROM cube_tags
GROUP BY is_adjacent, field, quick, CUBE (dataset, primary_type, status)"""


@register("facet_cube", (SCORED_SQL + _cube_sql("sc")).replace(")\n\n, cube_rows", "),\ncube_rows"))
def q_facet_cube(spark, sf):
    """Q7-Q9, Q12: every facet count of the run, by GROUPING SETS."""
    return run_of(spark, sf).cube().select(*facets.DIMS, "n")


@register("facet_cube_update", (SCORED_SQL + _cube_sql("sc")).replace(")\n\n, cube_rows", "),\ncube_rows"))
def q_facet_cube_update(spark, sf):
    """The previous run's cube plus the difference of the two runs is this run's."""
    from tidemark.plans.q_history import previous
    old = published.flat(previous(spark, sf).withColumnRenamed("prev_seq", "ingest_seq"), fx.PREVIOUS_TODAY).checkpoint()
    then = F.to_timestamp(F.lit(fx.PREVIOUS_STAMP))
    return facets.update_cube(facets.facet_cube(old, then), old, then, scored(spark, sf), now_ts(), "ingest_seq")


SORT_SQL = {
    "deadline": "coalesce(d_day, 99999) ASC",
    "newest": "first_seen_ts DESC",
    "updated": "coalesce(last_changed_ts, first_seen_ts) DESC",
    "relevance": "score DESC",
}


def _register_sort(mode: str):
    @register(f"sort_{mode}", SCORED_SQL + f"""
SELECT ingest_seq, CAST(row_number() OVER (ORDER BY {SORT_SQL[mode]}, ingest_seq) AS BIGINT) AS pos FROM sc WHERE {_sql_pred(Filters())}""")
    def q_sort(spark, sf):
        s = scored(spark, sf)
        s = s.where(_pred(s, Filters()))
        r = query.sort_rank(s, mode, "ingest_seq", first_seen="first_seen_ts", last_changed="last_changed_ts", last_seen="last_seen_ts")
        return r.select("ingest_seq", F.col("pos").cast("bigint").alias("pos"))
    return q_sort


for _m in SORT_SQL:
    _register_sort(_m)


@register("page_listings", SCORED_SQL + f"""
, v AS (SELECT * FROM sc WHERE dataset = 'active' AND {_sql_pred(Filters())}),
n AS (SELECT greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM v),
r AS (SELECT ingest_seq, row_number() OVER (ORDER BY score DESC, ingest_seq) AS pos FROM v)
SELECT ingest_seq, CAST(pos AS BIGINT) AS pos, CAST(least(2, pages) AS BIGINT) AS page, pages AS total_pages
FROM r, n WHERE pos > (least(2, pages) - 1) * 50 AND pos <= least(2, pages) * 50""".replace("\n, v AS", ",\nv AS"))
def q_page_listings(spark, sf):
    """Q11 on the active dataset, relevance order, page 2."""
    s = scored(spark, sf)
    v = s.where((F.col("dataset") == "active") & _pred(s, Filters())).select("ingest_seq", "score")
    out = query.page_slice(v, query.sort_order("relevance", "ingest_seq"), page=2)
    return out.select("ingest_seq", F.col("pos").cast("bigint"), F.col("page").cast("bigint"), F.col("total_pages").cast("bigint"))


@register("freshness", SCORED_SQL + f"""
SELECT CAST(count_if({_sql_quick('NEW')}) AS BIGINT) AS n_new, CAST(count_if({_sql_quick('UPDATED')}) AS BIGINT) AS n_updated,
       CAST(count_if({_sql_quick(tx.QUICK_TAGS[5])}) AS BIGINT) AS n_urgent FROM sc""")
def q_freshness(spark, sf):
    """Q12: counted over all rows, hidden ones included, from the cube."""
    c = run_of(spark, sf).cube()
    c = c.where((F.col("dataset") == facets.ANY) & (F.col("primary_type") == facets.ANY) & (F.col("status") == facets.ANY) & (F.col("field") == facets.ANY))
    return c.agg(*[_cube_sum(F.col("quick") == t).alias(n) for t, n in ((tx.QUICK_TAGS[3], "n_new"), (tx.QUICK_TAGS[4], "n_updated"), (tx.QUICK_TAGS[5], "n_urgent"))])


@register("dataset_scan", SCORED_SQL + "SELECT ingest_seq, id, status, CAST(d_day AS BIGINT) AS d_day FROM sc WHERE dataset = 'active'")
def q_dataset_scan(spark, sf):
    """Q13: one dataset, a partition of the stored run."""
    s = run_of(spark, sf).listings("active")
    return s.select("ingest_seq", "id", "status", F.col("d_day").cast("bigint"))


def _sql_label(mapping: dict, col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {sg.q(k)} THEN {sg.q(v)}" for k, v in mapping.items()) + f" ELSE {col} END"


def _sql_fmt(col: str) -> str:
    d = sg.iso_date(col)
    return f"CASE WHEN coalesce({col}, '') = '' THEN {sg.q(tx.DATE_UNKNOWN)} ELSE strftime({d}, '%Y. %m. %d.') END"


@register("display_rows", SCORED_SQL + f"""
SELECT ingest_seq,
  CASE WHEN status = 'ongoing' THEN {sg.q(tx.D_DAY_ONGOING)} WHEN status = 'unknown' THEN {sg.q(tx.D_DAY_UNKNOWN)}
       WHEN status = 'today' THEN {sg.q(tx.D_DAY_TODAY)} WHEN d_day IS NULL THEN {sg.q(tx.D_DAY_NONE)}
       WHEN d_day < 0 THEN 'D+' || CAST(abs(d_day) AS VARCHAR) ELSE 'D-' || CAST(d_day AS VARCHAR) END AS d_day_label,
  {_sql_label(tx.TYPE_LABELS, 'primary_type')} AS type_label, {_sql_label(tx.STATUS_LABELS, 'status')} AS status_label,
  array_to_string(list_slice(list_concat(field_tags, audience_tags), 1, 5), ' ') AS tags,
  {_sql_fmt('recruit_start')} AS start_label, {_sql_fmt('recruit_end')} AS end_label, source_name AS source_names
FROM sc WHERE dataset IS NOT NULL""")
def q_display_rows(spark, sf):
    """Q14: display projection of published rows."""
    s = scored(spark, sf).where(F.col("dataset").isNotNull())

    def fmt(c):
        from tidemark.functions.dates import parse_iso_date
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(tx.DATE_UNKNOWN)).otherwise(F.date_format(parse_iso_date(F.col(c)), "yyyy. MM. dd."))
    return s.select(
        "ingest_seq", query.d_day_label(F.col("status"), F.col("d_day")).alias("d_day_label"),
        query.label_map(tx.TYPE_LABELS, F.col("primary_type")).alias("type_label"),
        query.label_map(tx.STATUS_LABELS, F.col("status")).alias("status_label"),
        F.array_join(F.slice(F.concat("field_tags", "audience_tags"), 1, 5), " ").alias("tags"),
        fmt("recruit_start").alias("start_label"), fmt("recruit_end").alias("end_label"),
        F.array_join(F.transform("sources", lambda x: x["source_name"]), ", ").alias("source_names"))


@register("review_queue", SCORED_SQL + """
SELECT ingest_seq, title, source_name, organizer, CAST(score AS BIGINT) AS score, array_to_string(reasons, ' / ') AS reasons,
       CAST(row_number() OVER (ORDER BY score DESC, ingest_seq) AS BIGINT) AS pos FROM sc WHERE dataset = 'review'""")
def q_review_queue(spark, sf):
    """Q15: review dataset by descending score (stable)."""
    s = scored(spark, sf).where(F.col("dataset") == "review")
    r = query.sort_rank(s, "relevance", "ingest_seq")
    return r.select("ingest_seq", "title", "source_name", "organizer", F.col("score").cast("bigint"),
                    F.array_join("relevance.reasons", " / ").alias("reasons"), F.col("pos").cast("bigint"))


# ---- personal state (toggles_v) ----

def _state(spark, sf, with_restore=False):
    t = fx.toggles_v(spark, sf)
    r = table(spark, sf, "events").where(F.col("event_type") == "signup").select("user_id", "ts") if with_restore else None
    return personal.toggle_state(t, r)


@register("personal_toggle", """
SELECT user_id, bucket, listing_id FROM toggles_v GROUP BY user_id, bucket, listing_id HAVING count(*) % 2 = 1""")
def q_personal_toggle(spark, sf):
    return _state(spark, sf)


RESTORE_SQL = """
WITH r AS (SELECT user_id, max(ts) AS reset FROM events WHERE event_type = 'signup' GROUP BY user_id),
st AS (SELECT t.user_id, t.bucket, t.listing_id FROM toggles_v t LEFT JOIN r USING (user_id)
       WHERE t.bucket <> 'hidden' OR r.reset IS NULL OR t.ts > r.reset
       GROUP BY t.user_id, t.bucket, t.listing_id HAVING count(*) % 2 = 1)
"""


@register("personal_restore", RESTORE_SQL + "SELECT user_id, bucket, listing_id FROM st")
def q_personal_restore(spark, sf):
    return _state(spark, sf, with_restore=True)


@register("hide_listings", RESTORE_SQL + f"""
SELECT listing_id, primary_type FROM deadlines_v d
WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.user_id = {USER} AND st.bucket = 'hidden' AND st.listing_id = d.listing_id)""")
def q_hide_listings(spark, sf):
    d = fx.deadlines_v(spark, sf).select("listing_id", "primary_type")
    return personal.hide(d, _state(spark, sf, with_restore=True), USER)


@register("personal_flags", RESTORE_SQL + f"""
SELECT d.listing_id, coalesce(bool_or(st.bucket = 'favorites'), false) AS is_favorite, coalesce(bool_or(st.bucket = 'read'), false) AS is_read
FROM deadlines_v d LEFT JOIN st ON st.listing_id = d.listing_id AND st.user_id = {USER} GROUP BY d.listing_id""")
def q_personal_flags(spark, sf):
    d = fx.deadlines_v(spark, sf).select("listing_id")
    return personal.flags(d, _state(spark, sf, with_restore=True), USER).select("listing_id", "is_favorite", "is_read")


# ---- source health (run_log_v) ----

STREAK_SQL = """
WITH agg AS (
  SELECT source_id, arg_max(ok, run_seq) AS last_ok, max(CASE WHEN ok THEN finished_at END) AS last_success_at,
         max(CASE WHEN ok THEN run_seq END) AS last_ok_seq, CAST(count(*) AS BIGINT) AS runs
  FROM run_log_v GROUP BY source_id),
st AS (
  SELECT a.source_id, a.last_ok, a.last_success_at, a.runs,
    CAST((SELECT count(*) FROM run_log_v r WHERE r.source_id = a.source_id AND NOT r.ok AND (a.last_ok_seq IS NULL OR r.run_seq > a.last_ok_seq)) AS BIGINT) AS consecutive_failures
  FROM agg a)
"""
STALE_SQL = f"(last_success_at IS NULL OR last_success_at < TIMESTAMP '{fx.NOW_LOCAL}' - INTERVAL 24 HOUR OR consecutive_failures >= 3)"


def _streaks(spark, sf):
    s = health.streaks(fx.run_log_v(spark, sf))
    return s.withColumn("stale", health.is_stale(F.col("last_success_at"), F.col("consecutive_failures"), now_ntz()))


@register("failure_streak", STREAK_SQL + "SELECT source_id, consecutive_failures, strftime(last_success_at, '%Y-%m-%d %H:%M:%S.%f') AS last_success_at FROM st")
def q_failure_streak(spark, sf):
    """R2: failures since the last success per source (gaps and islands)."""
    s = _streaks(spark, sf)
    return s.select("source_id", "consecutive_failures", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_success_at"))


@register("source_stale", STREAK_SQL + f"SELECT source_id, {STALE_SQL} AS stale FROM st")
def q_source_stale(spark, sf):
    return _streaks(spark, sf).select("source_id", "stale")


@register("source_health", STREAK_SQL + f"""
SELECT source_id, CASE WHEN {STALE_SQL} THEN 'warning' WHEN last_ok THEN 'ok' ELSE 'failed' END AS health FROM st""")
def q_source_health(spark, sf):
    s = _streaks(spark, sf)
    return s.select("source_id", health.health_label(F.col("stale"), F.col("last_ok")).alias("health"))


@register("run_summary", STREAK_SQL + """
SELECT CAST(sum(runs) AS BIGINT) AS items, CAST(count_if(last_ok) AS BIGINT) AS succeeded, CAST(count_if(NOT last_ok) AS BIGINT) AS failed FROM st""")
def q_run_summary(spark, sf):
    """Runs, sources whose latest run succeeded / failed."""
    s = _streaks(spark, sf)
    return s.agg(F.sum("runs").cast("bigint").alias("items"), F.count_if("last_ok").cast("bigint").alias("succeeded"),
                 F.count_if(~F.col("last_ok")).cast("bigint").alias("failed"))


@register("latest_status", """
SELECT source_id, arg_max(ok, run_seq) AS ok, strftime(arg_max(finished_at, run_seq), '%Y-%m-%d %H:%M:%S.%f') AS finished_at,
       CAST(max(run_seq) AS BIGINT) AS run_seq FROM run_log_v GROUP BY source_id""")
def q_latest_status(spark, sf):
    """Last record per source wins."""
    r = fx.run_log_v(spark, sf)
    return r.groupBy("source_id").agg(F.max_by("ok", "run_seq").alias("ok"),
                                      F.date_format(F.max_by("finished_at", "run_seq"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("finished_at"),
                                      F.max("run_seq").cast("bigint").alias("run_seq"))


@register("is_new_events", f"""
SELECT event_id, coalesce(ts >= TIMESTAMP '{fx.NOW_LOCAL}' - INTERVAL 72 HOUR, false) AS is_new,
       coalesce(ts >= TIMESTAMP '{fx.NOW_LOCAL}' - INTERVAL 48 HOUR, false) AS is_updated FROM events""")
def q_is_new_events(spark, sf):
    """Q3 / Q4 on event times (local wall clock), now a parameter."""
    e = table(spark, sf, "events")
    return e.select("event_id", query.is_new(F.col("ts"), now_ntz()).alias("is_new"), query.is_updated(F.col("ts"), now_ntz()).alias("is_updated"))
