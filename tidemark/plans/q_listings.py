"""Queries over raw listings, pages and documents: normalisation (N*),
text and date extraction helpers (X2-X4, X14) and taxonomy scoring (C*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tf
from tidemark.functions.dates import dates_from_text, parse_date_text
from tidemark.functions.url import canonical_url
from tidemark.operators import classify as cl
from tidemark.operators import extract
from tidemark.operators import normalize as nz
from tidemark.plans import sqlgen as sg
from tidemark.plans.catalog import register
from tidemark.sources import fixtures as fx
from tidemark.sources.tables import spread, table

TAX = fx.LATIN_TAXONOMY
NORM_CTES, NORM = sg.normalized_ctes(TAX, fx.LISTING_TODAY, fx.NOW_ISO)


def normalized(spark, sf):
    """listings_v -> canonical listings under the Latin test taxonomy."""
    return nz.normalize(fx.listing_raw(spark, sf), TAX, fx.NOW_ISO, fx.LISTING_TODAY)


def _joined(col):
    return F.array_join(col, "|")


@register("canonical_url", f"SELECT page_id, {sg.canonical_url('url')} AS url_c FROM pages")
def q_canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", canonical_url(F.col("url")).alias("url_c"))


@register("canonical_url_listings", f"SELECT ingest_seq, {sg.canonical_url('source_url')} AS url_c FROM listings_v")
def q_canonical_url_listings(spark, sf):
    return fx.listings_v(spark, sf).select("ingest_seq", canonical_url(F.col("source_url")).alias("url_c"))


@register("match_key", f"""
SELECT doc_id, {sg.match_key("split_part(text, chr(10), 1)")} AS title_key,
       md5({sg.match_key('text')}) AS text_key_md5, CAST(length({sg.match_key('text')}) AS BIGINT) AS text_key_len
FROM documents""")
def q_match_key(spark, sf):
    d = table(spark, sf, "documents")
    key = tf.match_key(F.col("text"))
    return d.select("doc_id", tf.match_key(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("title_key"),
                    F.md5(key).alias("text_key_md5"), F.length(key).cast("bigint").alias("text_key_len"))


@register("fold_text", f"""
SELECT doc_id, lang, md5({sg.fold_text('text')}) AS folded_md5, CAST(length({sg.fold_text('text')}) AS BIGINT) AS folded_len
FROM documents""")
def q_fold_text(spark, sf):
    d = spread(table(spark, sf, "documents"))
    f = tf.fold_text(F.col("text"))
    return d.select("doc_id", "lang", F.md5(f).alias("folded_md5"), F.length(f).cast("bigint").alias("folded_len"))


@register("clean_text_docs", f"""
SELECT doc_id, md5({sg.collapse("coalesce(text, '')")}) AS clean_md5 FROM documents""")
def q_clean_text_docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(tf.clean_text(F.col("text"))).alias("clean_md5"))


@register("stable_id", f"SELECT ingest_seq, {sg.stable_id_expr()} AS id FROM listings_v")
def q_stable_id(spark, sf):
    d = fx.listings_v(spark, sf)
    return d.select("ingest_seq", nz.stable_id(F.col("source_id"), F.col("source_post_id"), F.col("source_url")).alias("id"))


@register("summary_contract", f"""
WITH r AS (SELECT *, {sg.RAW_CONSTANTS} FROM listings_v)
SELECT ingest_seq, {sg.summary_expr()} AS summary_c, CAST(length({sg.summary_expr()}) AS BIGINT) AS summary_len FROM r""")
def q_summary_contract(spark, sf):
    d = fx.listing_raw(spark, sf)
    s = nz.summarize(F.col("summary"), F.col("title"), F.col("eligibility"), F.col("benefits"))
    return d.select("ingest_seq", s.alias("summary_c"), F.length(s).cast("bigint").alias("summary_len"))


@register("title_organizer_clean", f"""
SELECT ingest_seq, {sg.title_expr()} AS title_c, {sg.organizer_expr()} AS organizer_c FROM listings_v""")
def q_title_organizer_clean(spark, sf):
    d = fx.listings_v(spark, sf)
    return d.select("ingest_seq", tf.strip_title_markers(F.col("title")).alias("title_c"),
                    nz.clean_organizer(F.col("organizer"), F.col("source_name")).alias("organizer_c"))


@register("dedupe_key", f"SELECT ingest_seq, {sg.dedupe_key_expr()} AS dedupe_key FROM listings_v")
def q_dedupe_key(spark, sf):
    d = fx.listings_v(spark, sf)
    org = nz.clean_organizer(F.col("organizer"), F.col("source_name"))
    return d.select("ingest_seq", nz.dedupe_key(F.col("title"), org, F.col("recruit_end")).alias("dedupe_key"))


@register("normalize_listing", f"""
WITH {NORM_CTES}
SELECT ingest_seq, id, title_c AS title, source_url_c AS source_url, organizer_c AS organizer, summary_c AS summary,
       primary_type, status, d_day, CAST(score AS BIGINT) AS score, decision, is_adjacent, dedupe_key, first_seen_at
FROM {NORM}""")
def q_normalize_listing(spark, sf):
    n = normalized(spark, sf)
    return n.select("ingest_seq", "id", "title", "source_url", "organizer", "summary", "primary_type", "status",
                    F.col("d_day").cast("bigint").alias("d_day"), F.col("relevance.score").cast("bigint").alias("score"),
                    F.col("relevance.decision").alias("decision"), "is_adjacent", "dedupe_key", "first_seen_at")


def _title_hits_sql() -> str:
    tax = cl.compile_taxonomy(TAX)
    items = [f"CASE WHEN {sg.keyword_hit('t', w)} THEN {sg.q(w)} END" for w in tax.all_keywords]
    return f"array_to_string({sg._list(items)}, '|')"


@register("keyword_hits", f"""
WITH f AS (SELECT ingest_seq, {sg.fold_text('title')} AS t FROM listings_v)
SELECT ingest_seq, {_title_hits_sql()} AS hits FROM f""")
def q_keyword_hits(spark, sf):
    d = fx.listings_v(spark, sf)
    words = list(cl.compile_taxonomy(TAX).all_keywords)
    return cl.keyword_hits(d, "title", words, "h").select("ingest_seq", _joined(F.col("h")).alias("hits"))


@register("primary_type", f"WITH {NORM_CTES} SELECT ingest_seq, primary_type FROM {NORM}")
def q_primary_type(spark, sf):
    return normalized(spark, sf).select("ingest_seq", "primary_type")


@register("field_tags", f"WITH {NORM_CTES} SELECT ingest_seq, array_to_string(field_tags, '|') AS field_tags FROM {NORM}")
def q_field_tags(spark, sf):
    return normalized(spark, sf).select("ingest_seq", _joined(F.col("field_tags")).alias("field_tags"))


@register("audience_tags", f"WITH {NORM_CTES} SELECT ingest_seq, array_to_string(audience_tags, '|') AS audience_tags FROM {NORM}")
def q_audience_tags(spark, sf):
    return normalized(spark, sf).select("ingest_seq", _joined(F.col("audience_tags")).alias("audience_tags"))


@register("relevance_score", f"WITH {NORM_CTES} SELECT ingest_seq, CAST(score AS BIGINT) AS score, decision FROM {NORM}")
def q_relevance_score(spark, sf):
    n = normalized(spark, sf)
    return n.select("ingest_seq", F.col("relevance.score").cast("bigint").alias("score"), F.col("relevance.decision").alias("decision"))


@register("decision_counts", f"""
WITH {NORM_CTES}
SELECT decision, primary_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(score) AS BIGINT) AS score_sum FROM {NORM} GROUP BY decision, primary_type""")
def q_decision_counts(spark, sf):
    n = normalized(spark, sf)
    return n.groupBy(F.col("relevance.decision").alias("decision"), "primary_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("relevance.score").cast("bigint").alias("score_sum"))


@register("score_reasons", f"WITH {NORM_CTES} SELECT ingest_seq, array_to_string(reasons, ' / ') AS reasons FROM {NORM}")
def q_score_reasons(spark, sf):
    n = normalized(spark, sf)
    return n.select("ingest_seq", F.array_join("relevance.reasons", " / ").alias("reasons"))


@register("adjacent_flag", f"WITH {NORM_CTES} SELECT ingest_seq, is_adjacent, primary_type, fee FROM {NORM}")
def q_adjacent_flag(spark, sf):
    n = normalized(spark, sf)
    raw = fx.listings_v(spark, sf).select("ingest_seq", "fee")
    return n.select("ingest_seq", "is_adjacent", "primary_type").join(raw, "ingest_seq")


# Date text derived from orders: year shifted into 20YY, month and day taken
# from the key so that invalid calendar dates (month 0/13, day 0/31+) occur.
DATE_TEXT_SPARK = {
    "k": "o_orderkey",
    "txt": ("concat('Apply ', CAST(year(o_orderdate) + 30 AS STRING), '.', CAST(o_orderkey % 14 AS STRING), '.', "
            "CAST(o_orderkey % 33 AS STRING), ' ~ ', CAST(year(o_orderdate) + 30 AS STRING), '/', "
            "CAST(month(o_orderdate) AS STRING), '/ ', CAST(o_orderkey % 29 + 1 AS STRING), ', then ', "
            "CAST(year(o_orderdate) + 31 AS STRING), '-', CAST(o_custkey % 12 + 1 AS STRING), '-', CAST(o_custkey % 31 + 1 AS STRING))"),
}


def _date_text(spark, sf):
    return table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in DATE_TEXT_SPARK.items()])


DATE_TEXT_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in DATE_TEXT_SPARK.items()).replace("AS STRING", "AS VARCHAR") + " FROM orders"
DATE_RE_SQL = r"(20[0-9]{2})[.\-/년\s]+([0-9]{1,2})[.\-/월\s]+([0-9]{1,2})"


def _sql_ymd(m: str) -> str:
    y = f"regexp_extract({m}, {sg.q(DATE_RE_SQL)}, 1)"
    mo = f"regexp_extract({m}, {sg.q(DATE_RE_SQL)}, 2)"
    d = f"regexp_extract({m}, {sg.q(DATE_RE_SQL)}, 3)"
    return f"CAST(CAST(try_strptime({y} || '-' || lpad({mo}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d') AS DATE) AS VARCHAR)"


@register("parse_date", f"""
WITH t AS ({DATE_TEXT_SQL})
SELECT k, {_sql_ymd('txt')} AS first_date FROM t""")
def q_parse_date(spark, sf):
    return _date_text(spark, sf).select("k", parse_date_text(F.col("txt")).alias("first_date"))


@register("date_range_text", f"""
WITH t AS ({DATE_TEXT_SQL}),
m AS (SELECT k, list_filter(list_transform(list_slice(regexp_extract_all(txt, {sg.q(DATE_RE_SQL)}), 1, 4), lambda x: {_sql_ymd('x')}), lambda x: x IS NOT NULL) AS v FROM t)
SELECT k, CASE WHEN len(v) >= 2 THEN v[1] END AS range_start,
          CASE WHEN len(v) = 1 THEN v[1] WHEN len(v) >= 2 THEN v[2] END AS range_end FROM m""")
def q_date_range_text(spark, sf):
    s, e = dates_from_text(F.col("txt"))
    return _date_text(spark, sf).select("k", s.alias("range_start"), e.alias("range_end"))


@register("date_range_docs", f"""
SELECT doc_id, CAST(NULL AS VARCHAR) AS range_start,
       CASE WHEN regexp_matches(text, {sg.q(DATE_RE_SQL)}) THEN 'has-date' END AS range_end FROM documents""")
def q_date_range_docs(spark, sf):
    s, e = dates_from_text(F.col("text"))
    d = table(spark, sf, "documents")
    return d.select("doc_id", s.alias("range_start"), F.when(e.isNotNull(), F.lit("has-date")).alias("range_end"))


LABEL_SQL = "der" + sg.WS + "*[:\uFF1A]?" + sg.WS + "*([^|]{2,100})"


@register("label_value", f"""
SELECT doc_id, {sg.collapse("regexp_extract(text, " + sg.q(LABEL_SQL) + ", 1)")} AS value
FROM documents""")
def q_label_value(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", extract.label_value(F.col("text"), "der").alias("value"))
