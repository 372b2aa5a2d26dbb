"""Layout queries: every layout job over the whole pages table, plus
SQL-checked forms of its rules on inputs Spark derives from the driver tables."""
from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.dates import epoch_ms_date
from tidemark.operators import layouts as ly
from tidemark.plans.catalog import register
from tidemark.sources import fixtures as fx
from tidemark.sources.tables import table

SRC = ly.Source("pages", "Pages", "aggregate", 40, list_url="https://pages.example.org/list", homepage="https://pages.example.org/")
RUN_DATE = fx.LISTING_TODAY


def _pages(spark, sf):
    return table(spark, sf, "pages")


def _out(df):
    return df.select("page_id", "pos", "source_url", "source_post_id", "title", "organizer", "recruit_start", "recruit_end", "date_kind")


for _name, _fn in {
    "layout_json_ld": lambda p: ly.json_ld_items(p, SRC, fx.NOW_ISO),
    "layout_structured": lambda p: ly.structured_pages(p, SRC, fx.NOW_ISO),
    "layout_notice_support": lambda p: ly.notice_rows(p, SRC, "support", fx.NOW_ISO),
    "layout_notice_event": lambda p: ly.notice_rows(p, SRC, "event", fx.NOW_ISO),
    "layout_support_table": lambda p: ly.support_table(p, SRC, fx.NOW_ISO),
    "layout_dday_list": lambda p: ly.dday_list(p, SRC, RUN_DATE, fx.NOW_ISO),
    "layout_category_list": lambda p: ly.category_list(p, SRC, RUN_DATE, fx.NOW_ISO),
    "layout_text_range_table": lambda p: ly.text_range_table(p, SRC, fx.NOW_ISO),
    "layout_open_rows_detail": lambda p: ly.open_rows_with_detail(p, p, SRC, fx.NOW_ISO),
    "layout_server_state": lambda p: ly.server_state(p, SRC, fx.NOW_ISO),
    "layout_endpoint_records": lambda p: ly.endpoint_records(p, SRC, fx.NOW_ISO, RUN_DATE, False),
    "layout_embedded_search": lambda p: ly.embedded_search(p, SRC, fx.NOW_ISO),
    "layout_markdown": lambda p: ly.markdown_lists(p, SRC, fx.NOW_ISO, 2024),
}.items():
    def _make(fn):
        def q(spark, sf):
            return _out(fn(_pages(spark, sf)))
        return q
    register(_name)(_make(_fn))


# ---- X17 short dates on text derived from orders (invalid months and days occur)
SHORT_TXT = ("concat('기간 ', lpad(CAST((year(o_orderdate) + 25) % 100 AS STRING), 2, '0'), '.', CAST(o_orderkey % 14 AS STRING), '.', "
             "CAST(o_orderkey % 33 AS STRING), ' ~ ', lpad(CAST((year(o_orderdate) + 26) % 100 AS STRING), 2, '0'), '.', "
             "lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', CAST(o_custkey % 31 + 1 AS STRING), ' 123.4.5')")
SHORT_SQL_RE = r"(^|[^0-9])([0-9]{2})\.([0-9]{1,2})\.([0-9]{1,2})([^0-9]|$)"


@register("short_dates", f"""
WITH t AS (SELECT o_orderkey AS k, {SHORT_TXT.replace('AS STRING', 'AS VARCHAR')} AS txt FROM orders),
m AS (SELECT k, list_filter(list_transform(regexp_extract_all(txt, '[0-9]+\\.[0-9]+\\.[0-9]+'), lambda x:
        CASE WHEN regexp_matches(x, '^[0-9]{{2}}\\.[0-9]{{1,2}}\\.[0-9]{{1,2}}$') THEN
        CAST(CAST(try_strptime('20' || split_part(x, '.', 1) || '-' || lpad(split_part(x, '.', 2), 2, '0') || '-' || lpad(split_part(x, '.', 3), 2, '0'), '%Y-%m-%d') AS DATE) AS VARCHAR) END),
      lambda x: x IS NOT NULL) AS d FROM t)
SELECT k, array_to_string(d, '|') AS dates FROM m""")
def q_short_dates(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.expr(SHORT_TXT).alias("txt"))
    return t.select("k", F.array_join(ly.short_dates(F.col("txt")), "|").alias("dates"))


# ---- X18 / X19 relative deadlines on day labels derived from lineitem
DDAY_TXT = "CASE WHEN l_linenumber % 3 = 0 THEN concat('D+', CAST(l_orderkey % 40 AS STRING)) WHEN l_linenumber % 3 = 1 THEN concat('마감 D-', CAST(l_partkey % 60 AS STRING)) ELSE '상시' END"


@register("relative_deadline", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {DDAY_TXT.replace('AS STRING', 'AS VARCHAR')} AS txt FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN regexp_matches(txt, 'D-[0-9]+') THEN CAST(DATE '{RUN_DATE}' + CAST(regexp_extract(txt, 'D-([0-9]+)', 1) AS INT) AS VARCHAR) END AS end_future_only,
  CASE WHEN regexp_matches(txt, 'D-[0-9]+') THEN CAST(DATE '{RUN_DATE}' + CAST(regexp_extract(txt, 'D-([0-9]+)', 1) AS INT) AS VARCHAR)
       WHEN regexp_matches(txt, 'D\\+[0-9]+') THEN CAST(DATE '{RUN_DATE}' - CAST(regexp_extract(txt, 'D\\+([0-9]+)', 1) AS INT) AS VARCHAR) END AS end_both
FROM t""")
def q_relative_deadline(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(DDAY_TXT).alias("txt"))
    run = F.lit(RUN_DATE).cast("date")
    return t.select("l_orderkey", "l_linenumber", ly.relative_deadline(F.col("txt"), run, False).alias("end_future_only"),
                    ly.relative_deadline(F.col("txt"), run, True).alias("end_both"))


# ---- X20 epoch milliseconds -> local calendar date
@register("epoch_ms_date", """
SELECT event_id, CAST(CAST(timezone('Asia/Seoul', make_timestamptz(epoch_ms(ts) * 1000)) AS DATE) AS VARCHAR) AS local_day FROM events""")
def q_epoch_ms_date(spark, sf):
    e = table(spark, sf, "events")
    ms = F.unix_millis(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return e.select("event_id", F.date_format(epoch_ms_date(ms), "yyyy-MM-dd").alias("local_day"))


# ---- X23 endpoint records derived from orders: open vs recently closed
REC = {"k": "o_orderkey", "process": "CASE WHEN o_orderstatus = 'F' THEN 'END' ELSE 'ING' END",
       "program_nm": "CASE WHEN o_orderkey % 4 = 0 THEN concat(o_orderpriority, ' // ', o_clerk_title) ELSE o_orderpriority END",
       "finish_dt": "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INT) AS STRING)"}
REC_BASE = "(SELECT *, concat('item ', CAST(o_custkey AS STRING)) AS o_clerk_title FROM orders)"
RECENT_TODAY = "1998-06-15"


@register("recent_closed_records", f"""
WITH r AS (SELECT {', '.join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in REC.items())} FROM {REC_BASE.replace('AS STRING', 'AS VARCHAR')} o)
SELECT k, CASE WHEN contains(program_nm, '//') THEN trim(regexp_extract(program_nm, '^.*//(.*)$', 1)) ELSE program_nm END AS title,
       process = 'END' AS ended
FROM r WHERE process = 'ING' OR (process = 'END' AND CAST(finish_dt AS DATE) >= CAST(DATE '{RECENT_TODAY}' - INTERVAL 3 MONTH AS DATE))""")
def q_recent_closed_records(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_clerk_title", F.concat(F.lit("item "), F.col("o_custkey").cast("string")))
    r = o.select(*[F.expr(e).alias(n) for n, e in REC.items()])
    title = F.when(F.col("program_nm").contains("//"), F.trim(F.regexp_extract("program_nm", r"^.*//(.*)$", 1))).otherwise(F.col("program_nm"))
    cutoff = F.add_months(F.lit(RECENT_TODAY).cast("date"), -3)
    keep = (F.col("process") == "ING") | ((F.col("process") == "END") & (F.col("finish_dt").cast("date") >= cutoff))
    return r.where(keep).select("k", title.alias("title"), (F.col("process") == "END").alias("ended"))


# ---- X24 raw-value unwrapping on events.props
@register("raw_unwrap_props", """
SELECT event_id, CAST(coalesce(json_extract(props, '$.k.raw'), json_extract(props, '$.k')) AS VARCHAR) AS k FROM events""")
def q_raw_unwrap_props(spark, sf):
    e = table(spark, sf, "events")
    v = F.coalesce(F.get_json_object("props", "$.k.raw"), F.get_json_object("props", "$.k"))
    return e.select("event_id", v.alias("k"))


# ---- X16 two feeds, first-seen distinct, quota two thirds / rest
FEED_LIMIT = 100


@register("feed_quota", f"""
WITH f AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS source_id, CAST(l_orderkey AS VARCHAR) AS source_post_id, l_orderkey AS k, l_linenumber AS n,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS feed FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY feed, source_id, source_post_id ORDER BY k, n) AS rn FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY feed, source_id ORDER BY k, n) AS pos FROM d WHERE rn = 1)
SELECT source_id, source_post_id, CAST(feed AS INTEGER) AS feed_ord FROM r
WHERE (feed = 0 AND pos <= {max(1, round(FEED_LIMIT * 0.67))}) OR (feed = 1 AND pos <= {max(1, FEED_LIMIT - max(1, round(FEED_LIMIT * 0.67)))})""")
def q_feed_quota(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"),
                                             F.col("l_orderkey").cast("string").alias("source_post_id"),
                                             F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_returnflag")
    li = li.withColumn("source_url", F.lit(None).cast("string"))
    sup = li.where(F.col("l_returnflag") == "R")
    ev = li.where(F.col("l_returnflag") != "R")
    out = ly.feed_quota(sup, ev, FEED_LIMIT, ["k", "n"])
    return out.select("source_id", "source_post_id", F.col("feed_ord").cast("int").alias("feed_ord"))


# ---- X15 on notice-table pages that Spark derives from orders (one page per
# order; every third page also carries a malformed short row)
NOTICE_PAGE = {
    "page_id": "o_orderkey",
    "url": "concat('https://biz.example.org/list?keyword=K', CAST(o_custkey % 7 AS STRING))",
    "html": ("concat('<table><tr class=\"r\"><td>', CAST(o_orderkey % 100 AS STRING), '</td><td>', o_orderpriority, '</td>', "
             "'<td><a href=\"/sii/selectSIIA200Detail.do?pblancId=P', CAST(o_orderkey AS STRING), '&amp;x=1\">Notice ', "
             "CAST(o_custkey AS STRING), ' &amp; <b>plan</b> 페이지 이동</a></td><td>', "
             "CAST(year(o_orderdate) + 28 AS STRING), '.', CAST(month(o_orderdate) AS STRING), '.', CAST(o_orderkey % 31 + 1 AS STRING), "
             "' ~ ', CAST(year(o_orderdate) + 28 AS STRING), '. ', CAST(o_orderkey % 13 AS STRING), '. 15', "
             "'</td><td>-</td><td>', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('Org ', CAST(o_custkey % 11 AS STRING)) END, "
             "'</td><td>x</td></tr>', CASE WHEN o_orderkey % 3 = 0 THEN '<tr><td><a href=\"/sii/selectSIIA200Detail.do?pblancId=Q\">s</a></td></tr>' ELSE '' END, "
             "'</table>')"),
}


def _notice_pages_sql() -> str:
    return "SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in NOTICE_PAGE.items()) + " FROM orders"


def _notice_sql() -> str:
    from tidemark.plans import sqlgen as sg
    from tidemark.plans.q_listings import DATE_RE_SQL, _sql_ymd
    row_re, cell_re, link_re = ly.ROW_RE, ly.CELL_RE, ly.BIZ_LINK

    def strip(e):
        un = e
        from tidemark.functions.text import HTML_ENTITIES
        for ent, ch in HTML_ENTITIES:
            un = f"replace({un}, {sg.q(ent)}, {sg.q(ch)})"
        tagless = f"regexp_replace({un}, '<[^>]+>', ' ', 'g')"
        for ent, ch in HTML_ENTITIES:
            tagless = f"replace({tagless}, {sg.q(ent)}, {sg.q(ch)})"
        return sg.collapse(tagless)
    period_dates = (f"list_filter(list_transform(list_slice(regexp_extract_all(period, {sg.q(DATE_RE_SQL)}), 1, 4), "
                    f"lambda x: {_sql_ymd('x')}), lambda x: x IS NOT NULL)")
    return f"""
WITH pg AS ({_notice_pages_sql()}),
rows_ AS (SELECT page_id, url, unnest(regexp_extract_all(html, {sg.q(row_re)}, 1)) AS body,
                 unnest(range(len(regexp_extract_all(html, {sg.q(row_re)}, 1)))) AS pos FROM pg),
cells AS (SELECT *, list_transform(regexp_extract_all(body, {sg.q(cell_re)}, 1), lambda c: {strip('c')}) AS cl FROM rows_
          WHERE regexp_matches(body, {sg.q(link_re)})),
sel AS (SELECT *, cl[2] AS category, cl[4] AS period, cl[6] AS organizer0 FROM cells WHERE len(cl) >= 7),
dt AS (SELECT *, {period_dates} AS d,
   'https://biz.example.org' || replace(regexp_extract(body, {sg.q(link_re)}, 1), '&amp;', '&') AS link FROM sel)
SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(link, '[?&]pblancId=([^&#]*)', 1) AS source_post_id,
  regexp_replace({strip("regexp_extract(body, " + sg.q(link_re) + ", 2)")}, {sg.q(sg.WS + '*페이지(?:로)?' + sg.WS + '*이동$')}, '') AS title,
  CASE WHEN organizer0 <> '' THEN organizer0 ELSE {sg.q(SRC.name)} END AS organizer,
  CASE WHEN len(d) >= 2 THEN d[1] END AS recruit_start, CASE WHEN len(d) = 1 THEN d[1] WHEN len(d) >= 2 THEN d[2] END AS recruit_end,
  '기업마당 공개 지원사업 · ' || category || ' · 검색어 ' || regexp_extract(url, '[?&]keyword=([^&#]*)', 1) AS summary
FROM dt"""


def notice_pages(spark, sf):
    return table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in NOTICE_PAGE.items()])


@register("notice_table_orders", _notice_sql())
def q_notice_table_orders(spark, sf):
    out = ly.notice_rows(notice_pages(spark, sf), SRC, "support", fx.NOW_ISO)
    return out.select("page_id", F.col("pos").cast("bigint"), "source_post_id", "title", "organizer", "recruit_start", "recruit_end", "summary")


# ---- X19 on list pages derived from lineitem (one page per line item)
LIST_PAGE = {
    "page_id": "l_orderkey * 10 + l_linenumber",
    "url": "'https://wev.example.org/list'",
    "html": ("concat('<ul><li class=\"item\"><div class=\"tit\"><a href=\"?c=find&amp;gbn=view&amp;ix=', CAST(l_partkey AS STRING), '\">Part ', "
             "CAST(l_partkey AS STRING), ' <i>contest</i></a></div><div class=\"sub-tit\">분야 : ', l_returnflag, '/', l_linestatus, '</div>', "
             "'<div class=\"organ\">', CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE concat('Supp ', CAST(l_suppkey AS STRING)) END, '</div>', "
             "'<div class=\"day\">', CASE WHEN l_linenumber % 3 = 0 THEN concat('D+', CAST(l_orderkey % 20 AS STRING)) "
             "WHEN l_linenumber % 3 = 1 THEN concat('D-', CAST(l_partkey % 40 AS STRING)) ELSE '상시' END, '</div></li>', "
             "CASE WHEN l_linenumber = 1 THEN '<li><div class=\"tit\"><a href=\"?gbn=view&amp;ix=0\">no meta</a></div></li>' ELSE '' END, '</ul>')"),
}


def _list_sql() -> str:
    from tidemark.plans import sqlgen as sg
    from tidemark.functions.text import HTML_ENTITIES

    def strip(e):
        un = e
        for ent, ch in HTML_ENTITIES:
            un = f"replace({un}, {sg.q(ent)}, {sg.q(ch)})"
        tagless = f"regexp_replace({un}, '<[^>]+>', ' ', 'g')"
        for ent, ch in HTML_ENTITIES:
            tagless = f"replace({tagless}, {sg.q(ent)}, {sg.q(ch)})"
        return sg.collapse(tagless)

    def div(cls):
        pat = r"""(?is)<div\s+class=["'][^"']*\b""" + re.escape(cls) + r"""\b[^"']*["'][^>]*>(.*?)</div>"""
        return strip(f"regexp_extract(body, {sg.q(pat)}, 1)")
    pages = "SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in LIST_PAGE.items()) + " FROM lineitem"
    day = div("day")
    cat = f"regexp_replace({div('sub-tit')}, {sg.q('^분야' + sg.WS + '*:' + sg.WS + '*')}, '')"
    link = f"'https://wev.example.org/list' || replace(regexp_extract(body, {sg.q(ly.WEV_LINK)}, 1), '&amp;', '&')"
    return f"""
WITH pg AS ({pages}),
rows_ AS (SELECT page_id, unnest(regexp_extract_all(html, {sg.q(ly.LI_RE)}, 1)) AS body,
                 unnest(range(len(regexp_extract_all(html, {sg.q(ly.LI_RE)}, 1)))) AS pos FROM pg),
sel AS (SELECT *, {day} AS day_t, {cat} AS cat, {div('organ')} AS organ, {link} AS link FROM rows_
        WHERE regexp_matches(body, {sg.q(ly.WEV_LINK)}) AND contains(body, 'sub-tit') AND contains(body, 'organ'))
SELECT page_id, CAST(pos AS BIGINT) AS pos, link AS source_url, regexp_extract(link, '[?&]ix=([^&#]*)', 1) AS source_post_id,
  {strip("regexp_extract(body, " + sg.q(ly.WEV_LINK) + ", 2)")} AS title,
  CASE WHEN organ <> '' THEN organ ELSE {sg.q(SRC.name)} END AS organizer,
  CASE WHEN regexp_matches(day_t, '(?i)D-[0-9]+') THEN CAST(DATE '{RUN_DATE}' + CAST(regexp_extract(day_t, '(?i)D-([0-9]+)', 1) AS INT) AS VARCHAR)
       WHEN regexp_matches(day_t, '(?i)D\\+[0-9]+') THEN CAST(DATE '{RUN_DATE}' - CAST(regexp_extract(day_t, '(?i)D\\+([0-9]+)', 1) AS INT) AS VARCHAR) END AS recruit_end,
  cat AS original_category
FROM sel"""


@register("list_layout_lineitem", _list_sql())
def q_list_layout_lineitem(spark, sf):
    pages = table(spark, sf, "lineitem").select(*[F.expr(e).alias(n) for n, e in LIST_PAGE.items()])
    out = ly.category_list(pages, SRC, RUN_DATE, fx.NOW_ISO)
    return out.select("page_id", F.col("pos").cast("bigint"), "source_url", "source_post_id", "title", "organizer", "recruit_end", "original_category")


def _strip_sql(e: str) -> str:
    from tidemark.functions.text import HTML_ENTITIES
    from tidemark.plans import sqlgen as sg
    un = e
    for ent, ch in HTML_ENTITIES:
        un = f"replace({un}, {sg.q(ent)}, {sg.q(ch)})"
    tagless = f"regexp_replace({un}, '<[^>]+>', ' ', 'g')"
    for ent, ch in HTML_ENTITIES:
        tagless = f"replace({tagless}, {sg.q(ent)}, {sg.q(ch)})"
    return sg.collapse(tagless)


def _pages_sql(spec: dict, source: str) -> str:
    return "SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in spec.items()) + f" FROM {source}"


# ---- X17 on support tables derived from part (short YY.MM.DD periods, some invalid)
SUPPORT_PAGE = {
    "page_id": "p_partkey",
    "url": "'https://kocca.example.org/list'",
    "html": ("concat('<table><tr><td>', p_brand, '</td><td><a href=\"/kocca/pims/view.do?intcNo=', CAST(p_partkey AS STRING), "
             "'&amp;menuNo=1\">', p_name, '</a></td><td>', lpad(CAST(p_size % 30 AS STRING), 2, '0'), '.', CAST(p_partkey % 14 AS STRING), '.', "
             "CAST(p_partkey % 32 AS STRING), ' ~ ', lpad(CAST(p_size % 30 + 1 AS STRING), 2, '0'), '.0', CAST(p_partkey % 9 + 1 AS STRING), '.28', "
             "'</td><td>open</td></tr>', CASE WHEN p_partkey % 4 = 0 THEN '<tr><td><a href=\"/kocca/pims/view.do?intcNo=0\">x</a></td><td>y</td></tr>' ELSE '' END, "
             "'</table>')"),
}


def _support_sql() -> str:
    from tidemark.plans import sqlgen as sg
    short = r"(^|[^0-9])([0-9]{2})\.([0-9]{1,2})\.([0-9]{1,2})([^0-9]|$)"
    dates = (f"list_filter(list_transform(regexp_extract_all(cl[len(cl) - 1], '[0-9]+\\.[0-9]+\\.[0-9]+'), lambda x: CASE WHEN "
             f"regexp_matches(x, '^[0-9]{{2}}\\.[0-9]{{1,2}}\\.[0-9]{{1,2}}$') THEN CAST(CAST(try_strptime('20' || split_part(x, '.', 1) || '-' || "
             f"lpad(split_part(x, '.', 2), 2, '0') || '-' || lpad(split_part(x, '.', 3), 2, '0'), '%Y-%m-%d') AS DATE) AS VARCHAR) END), lambda x: x IS NOT NULL)")
    del short
    return f"""
WITH pg AS ({_pages_sql(SUPPORT_PAGE, 'part')}),
rows_ AS (SELECT page_id, unnest(regexp_extract_all(html, {sg.q(ly.ROW_RE)}, 1)) AS body,
                 unnest(range(len(regexp_extract_all(html, {sg.q(ly.ROW_RE)}, 1)))) AS pos FROM pg),
c AS (SELECT *, list_transform(regexp_extract_all(body, {sg.q(ly.CELL_RE)}, 1), lambda x: {_strip_sql('x')}) AS cl FROM rows_
      WHERE regexp_matches(body, {sg.q(ly.KOCCA_LINK)})),
d AS (SELECT *, {dates} AS p FROM c WHERE len(cl) >= 4)
SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(replace(regexp_extract(body, {sg.q(ly.KOCCA_LINK)}, 1), '&amp;', '&'), '[?&]intcNo=([^&#]*)', 1) AS source_post_id,
  {_strip_sql("regexp_extract(body, " + sg.q(ly.KOCCA_LINK) + ", 2)")} AS title, p[1] AS recruit_start,
  CASE WHEN len(p) > 1 THEN p[2] ELSE p[1] END AS recruit_end,
  regexp_replace('디지털 콘텐츠 · ' || cl[1], '^[ ·]+|[ ·]+$', '', 'g') AS original_category
FROM d"""


@register("support_table_part", _support_sql())
def q_support_table_part(spark, sf):
    pages = table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in SUPPORT_PAGE.items()])
    out = ly.support_table(pages, SRC, fx.NOW_ISO)
    return out.select("page_id", F.col("pos").cast("bigint"), "source_post_id", "title", "recruit_start", "recruit_end", "original_category")


# ---- X21 on notice tables derived from customer (date range in the row text)
RANGE_PAGE = {
    "page_id": "c_custkey",
    "url": "'https://nipa.example.org/home/2-2'",
    "html": ("concat('<table><tr><td>', CAST(c_custkey % 50 AS STRING), '</td><td><a href=\"/home/2-2/', CAST(c_custkey AS STRING), '\">', "
             "c_name, ' <span>', c_mktsegment, '</span></a></td><td>', CAST(2020 + c_nationkey % 8 AS STRING), '-', "
             "CAST(c_custkey % 12 + 1 AS STRING), '-', CAST(c_custkey % 30 + 1 AS STRING), ' ~ ', CAST(2021 + c_nationkey % 8 AS STRING), '/', "
             "CAST(c_custkey % 15 AS STRING), '/', CAST(c_custkey % 29 + 3 AS STRING), '</td></tr><tr><td>no link</td></tr></table>')"),
}


def _range_sql() -> str:
    from tidemark.plans import sqlgen as sg
    from tidemark.plans.q_listings import DATE_RE_SQL, _sql_ymd
    dates = (f"list_filter(list_transform(list_slice(regexp_extract_all(t, {sg.q(DATE_RE_SQL)}), 1, 4), lambda x: {_sql_ymd('x')}), "
             f"lambda x: x IS NOT NULL)")
    return f"""
WITH pg AS ({_pages_sql(RANGE_PAGE, 'customer')}),
rows_ AS (SELECT page_id, unnest(regexp_extract_all(html, {sg.q(ly.ROW_RE)}, 1)) AS body,
                 unnest(range(len(regexp_extract_all(html, {sg.q(ly.ROW_RE)}, 1)))) AS pos FROM pg),
s AS (SELECT *, {_strip_sql('body')} AS t FROM rows_ WHERE regexp_matches(body, {sg.q(ly.NIPA_LINK)})),
d AS (SELECT *, {dates} AS dl FROM s)
SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(body, {sg.q(ly.NIPA_LINK)}, 2) AS source_post_id,
  'https://nipa.example.org' || regexp_extract(body, {sg.q(ly.NIPA_LINK)}, 1) AS source_url,
  {_strip_sql("regexp_extract(body, " + sg.q(ly.NIPA_LINK) + ", 3)")} AS title,
  CASE WHEN len(dl) >= 2 THEN dl[1] END AS recruit_start, CASE WHEN len(dl) = 1 THEN dl[1] WHEN len(dl) >= 2 THEN dl[2] END AS recruit_end
FROM d"""


@register("range_table_customer", _range_sql())
def q_range_table_customer(spark, sf):
    pages = table(spark, sf, "customer").select(*[F.expr(e).alias(n) for n, e in RANGE_PAGE.items()])
    out = ly.text_range_table(pages, SRC, fx.NOW_ISO)
    return out.select("page_id", F.col("pos").cast("bigint"), "source_post_id", "source_url", "title", "recruit_start", "recruit_end")


# ---- X18 on list pages derived from orders (items lacking D-n are dropped)
DDAY_PAGE = {
    "page_id": "o_orderkey",
    "url": "'https://ks.example.org/list'",
    "html": ("concat('<div><a href=\"javascript:go_view(', CAST(o_orderkey AS STRING), ');\" class=\"x\"><p class=\"tit\">Plan ', "
             "o_orderpriority, ' <b>', CAST(o_custkey AS STRING), '</b></p><span>', "
             "CASE WHEN o_orderkey % 4 = 0 THEN '상시' ELSE concat('D-', CAST(o_orderkey % 45 AS STRING)) END, '</span></a></div>')"),
}


def _dday_sql() -> str:
    from tidemark.plans import sqlgen as sg
    base = ly.with_query(SRC.list_url, schM="view", pbancSn="__ID__")
    return f"""
WITH pg AS ({_pages_sql(DDAY_PAGE, 'orders')}),
it AS (SELECT page_id, unnest(regexp_extract_all(html, {sg.q(ly.KS_ITEM)}, 0)) AS a,
              unnest(range(len(regexp_extract_all(html, {sg.q(ly.KS_ITEM)}, 0)))) AS pos FROM pg),
b AS (SELECT *, regexp_extract(a, {sg.q(ly.KS_ITEM)}, 1) AS pid, regexp_extract(a, {sg.q(ly.KS_ITEM)}, 2) AS body FROM it)
SELECT page_id, CAST(pos AS BIGINT) AS pos, pid AS source_post_id, replace({sg.q(base)}, '__ID__', pid) AS source_url,
  {_strip_sql("regexp_extract(body, " + sg.q(ly.KS_TITLE) + ", 1)")} AS title,
  CAST(DATE '{RUN_DATE}' + CAST(regexp_extract(body, '(?i)D-([0-9]+)', 1) AS INT) AS VARCHAR) AS recruit_end
FROM b WHERE regexp_matches(body, {sg.q(ly.KS_TITLE)}) AND regexp_matches(body, '(?i)D-[0-9]+')"""


@register("dday_list_orders", _dday_sql())
def q_dday_list_orders(spark, sf):
    pages = table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in DDAY_PAGE.items()])
    out = ly.dday_list(pages, SRC, RUN_DATE, fx.NOW_ISO)
    return out.select("page_id", F.col("pos").cast("bigint"), "source_post_id", "source_url", "title", "recruit_end")
