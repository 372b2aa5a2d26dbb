"""Extraction queries over the pages and documents tables (X1, X7, X10,
X12, X13, X27, X28)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import taxonomy as tx
from tidemark.operators import extract
from tidemark.plans import sqlgen as sg
from tidemark.plans.catalog import register
from tidemark.plans.q_run import SOURCES_SQL, selected
from tidemark.sources import fixtures as fx
from tidemark.sources.tables import dealt, table


@register("page_parse")
def q_page_parse(spark, sf):
    """Links, meta map, JSON-LD blocks and visible text per page."""
    p = extract.parse_pages(table(spark, sf, "pages"))
    return p.select("page_id", F.size("links").alias("n_links"), F.size("metas").alias("n_metas"), F.size("json_ld").alias("n_json_ld"),
                    F.length("text").alias("text_len"), F.md5("text").alias("text_md5"), "title")


def _resolve_sql(base: str, href: str) -> str:
    scheme = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)"
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    base_dir = f"regexp_extract({base}, '^([^?#]*/)', 1)"
    return (f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} "
            f"WHEN starts_with({href}, '/') THEN {origin} || {href} ELSE {base_dir} || {href} END")


ANCHOR_SQL = extract.ANCHOR_RE
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"


def _unescape_sql(e: str) -> str:
    from tidemark.functions.text import HTML_ENTITIES
    out = e
    for ent, ch in HTML_ENTITIES:
        out = f"replace({out}, {sg.q(ent)}, {sg.q(ch)})"
    return out


def _link_candidates_sql() -> str:
    host = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
    words = " OR ".join(f"contains(lower(text), {sg.q(w)})" for w in extract.OPPORTUNITY_WORDS)
    nav = " OR ".join(f"contains(text, {sg.q(p)})" for p in extract.NAVIGATION_PHRASES)
    return f"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, {sg.q(ANCHOR_SQL)})) AS a,
                  unnest(range(len(regexp_extract_all(html, {sg.q(ANCHOR_SQL)})))) AS pos FROM pages),
b AS (SELECT page_id, url, pos, {_resolve_sql('url', "regexp_extract(a, " + sg.q(ANCHOR_SQL) + ", 1)")} AS link,
             {sg.collapse(_unescape_sql("regexp_extract(a, " + sg.q(ANCHOR_SQL) + ", 2)"))} AS text FROM a),
c AS (SELECT * FROM b WHERE {host.format(u='link')} = {host.format(u='url')} AND length(text) >= 8 AND ({words}) AND NOT ({nav})
        AND regexp_replace(link, '/+$', '') <> regexp_replace(url, '/+$', '')),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS rn FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM f WHERE rn = 1)
SELECT page_id, link, text, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 500"""


# Pages derived from part: markup, quoting and relative links that a list page may use.
PART_URL = "concat('https://h.example.org/list/', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'p?x=1' END)"


def _part_html():
    key = F.col("p_partkey").cast("string")
    return F.concat(
        F.lit('<a href="?c='), key, F.lit('"><b>contest</b> number '), key, F.lit("</a><a class=x href='../v/"), key,
        F.lit("'>hackathon &amp; game jam &#8211; "), F.col("p_name"), F.lit('</a><a href="//other.example.org/contest">contest elsewhere</a>'),
        F.lit('<a href="/short">contest</a><a href="../v/./'), key, F.lit('">contest seen before</a>'))


@register("link_candidates_part", f"""
WITH p AS (SELECT p_partkey, {PART_URL.replace("AS STRING", "AS VARCHAR")} AS url, p_name FROM part)
SELECT p_partkey AS page_id, regexp_replace(url, '[?].*$', '') || '?c=' || p_partkey AS link, 'contest number ' || p_partkey AS text, CAST(1 AS INTEGER) AS rank FROM p
UNION ALL
SELECT p_partkey, 'https://h.example.org/v/' || p_partkey, 'hackathon & game jam – ' || {sg.collapse('p_name')}, CAST(2 AS INTEGER) FROM p""")
def q_link_candidates_part(spark, sf):
    """X7 over pages derived from part: bold and quoted anchors, query-only and
    dotted links, references, a foreign host, a short text, a repeated link."""
    pages = dealt(table(spark, sf, "part")).select(F.col("p_partkey").alias("page_id"), F.expr(PART_URL).alias("url"), _part_html().alias("html"))
    return extract.link_candidates(pages).select("page_id", "link", "text", F.col("rank").cast("int"))


@register("link_candidates", _link_candidates_sql())
def q_link_candidates(spark, sf):
    """Listing-link candidates per page."""
    return extract.link_candidates(table(spark, sf, "pages")).select("page_id", "link", "text", F.col("rank").cast("int"))


@register("page_detail")
def q_page_detail(spark, sf):
    """X10 + X13: detail records from parsed pages (source name = host)."""
    p = extract.parse_pages(table(spark, sf, "pages"))
    host = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    d = extract.detail_records(p.withColumn("host", host), F.col("host"))
    return d.select("page_id", "title", "organizer", "summary", F.length("body_text").alias("body_len"), "recruit_start", "recruit_end")


def _first_sentence_sql() -> str:
    ws = sg.WS
    title = "split_part(text, chr(10), 1)"
    without = (f"(CASE WHEN {title} <> '' AND strpos(text, {title}) > 0 THEN substr(text, 1, strpos(text, {title}) - 1) "
               f"|| substr(text, strpos(text, {title}) + length({title})) ELSE text END)")
    marked = f"regexp_replace(regexp_replace({without}, {sg.q('([.!?' + chr(0xB2E4) + '])' + ws + '+')}, '\\1' || chr(1), 'g'), {sg.q(ws + '{2,}')}, chr(1), 'g')"
    pieces = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {sg.collapse('p')}), lambda p: length(p) BETWEEN 40 AND 220)"
    return f"coalesce(substr({pieces}[1], 1, 180), {sg.q(tx.DETAIL_DEFAULT)})"


@register("first_sentence", f"SELECT doc_id, {_first_sentence_sql()} AS sentence FROM documents")
def q_first_sentence(spark, sf):
    """X13 over whole documents (title = first line)."""
    d = table(spark, sf, "documents")
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return d.select("doc_id", extract.first_sentence(F.col("text"), title).alias("sentence"))


@register("raw_defaults", f"""
SELECT ingest_seq, CASE WHEN coalesce(organizer, '') = '' THEN source_name ELSE organizer END AS organizer,
       substr(CASE WHEN coalesce(summary, '') = '' THEN {sg.q(tx.DETAIL_DEFAULT)} ELSE summary END, 1, 180) AS summary,
       CASE WHEN recruit_end IS NOT NULL AND recruit_end <> '' THEN 'exact' ELSE 'unknown' END AS date_kind
FROM listings_v""")
def q_raw_defaults(spark, sf):
    """Organizer defaults to the source name, summary default and cut
    180, date kind exact iff an end date exists."""
    d = fx.listings_v(spark, sf)
    return d.select("ingest_seq",
                    F.when(F.coalesce("organizer", F.lit("")) == "", F.col("source_name")).otherwise(F.col("organizer")).alias("organizer"),
                    F.substring(F.when(F.coalesce("summary", F.lit("")) == "", F.lit(tx.DETAIL_DEFAULT)).otherwise(F.col("summary")), 1, 180).alias("summary"),
                    F.when(F.coalesce("recruit_end", F.lit("")) != "", "exact").otherwise("unknown").alias("date_kind"))


LIMIT = 30


@register("per_source_limit", f"""
WITH f AS (SELECT ingest_seq, source_id, coalesce(source_post_id, source_url) AS k FROM listings_v),
d AS (SELECT *, row_number() OVER (PARTITION BY source_id, k ORDER BY ingest_seq) AS rn FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ingest_seq) AS pos FROM d WHERE rn = 1)
SELECT ingest_seq, source_id, CAST(pos AS BIGINT) AS pos FROM r WHERE pos <= {LIMIT}""")
def q_per_source_limit(spark, sf):
    """First-seen distinct by post id (else URL), then the per-source cap
    (a limit that is the feature: the collector's row cap)."""
    d = fx.listings_v(spark, sf).withColumn("k", F.coalesce("source_post_id", "source_url"))
    first = d.withColumn("rn", F.row_number().over(Window.partitionBy("source_id", "k").orderBy("ingest_seq"))).where("rn = 1")
    r = first.withColumn("pos", F.row_number().over(Window.partitionBy("source_id").orderBy("ingest_seq")))
    return r.where(F.col("pos") <= LIMIT).select("ingest_seq", "source_id", F.col("pos").cast("bigint"))


@register("empty_source_guard", "WITH " + SOURCES_SQL.replace("enabled AND ('fast' = 'all' OR schedule = 'fast')", "enabled") + """,
n AS (SELECT concat('src', CAST(l_suppkey % 17 AS VARCHAR)) AS source_id, count(*) AS c FROM lineitem GROUP BY 1)
SELECT s.source_id, CAST(coalesce(n.c, 0) AS BIGINT) AS collected, CASE WHEN coalesce(n.c, 0) = 0 THEN 'failed' ELSE 'success' END AS status
FROM selected s LEFT JOIN n USING (source_id)""")
def q_empty_source_guard(spark, sf):
    """A selected source that yields no rows is a failure, not an empty
    success (rows here: lineitem, whose suppliers map to fewer sources than are
    selected, so some sources truly have none)."""
    sel = selected(spark, sf, schedule="all")
    n = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("src"), (F.col("l_suppkey") % 17).cast("string")).alias("source_id")).agg(F.count(F.lit(1)).alias("c"))
    j = sel.select("source_id").join(n, "source_id", "left")
    c = F.coalesce("c", F.lit(0))
    return j.select("source_id", c.cast("bigint").alias("collected"), F.when(c == 0, "failed").otherwise("success").alias("status"))


@register("detail_fallback_join", f"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, {sg.q(ANCHOR_SQL)})) AS a,
                  unnest(range(len(regexp_extract_all(html, {sg.q(ANCHOR_SQL)})))) AS pos FROM pages),
b AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {_resolve_sql('url', "regexp_extract(a, " + sg.q(ANCHOR_SQL) + ", 1)")} AS link,
             {sg.collapse(_unescape_sql("regexp_extract(a, " + sg.q(ANCHOR_SQL) + ", 2)"))} AS text FROM a),
d AS (SELECT url AS link, arg_min({sg.collapse(_unescape_sql("regexp_extract(html, " + sg.q(TITLE_TAG) + ", 1)"))}, page_id) AS d_title FROM pages GROUP BY url)
SELECT b.page_id, b.pos, b.link, d.d_title IS NOT NULL AS has_detail, coalesce(d.d_title, b.text) AS title,
       CASE WHEN d.d_title IS NULL THEN {sg.q(tx.DETAIL_DEFAULT)} END AS summary
FROM b LEFT JOIN d USING (link)""")
def q_detail_fallback_join(spark, sf):
    p = table(spark, sf, "pages")
    return extract.detail_fallback_join(p, p).select("page_id", F.col("pos").cast("int").alias("pos"), "link", "has_detail", "title", "summary")
