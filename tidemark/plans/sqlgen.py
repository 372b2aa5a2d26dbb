"""DuckDB SQL text for the oracle queries.

These builders only produce SQL strings for the correctness oracle; the
engine itself never runs them. They restate each rule in plain SQL (RE2
regexes, list lambdas) from the same configuration values.
"""
from __future__ import annotations

from tidemark.config import taxonomy as tx
from tidemark.functions.text import MATCH_KEY_DROP, whitespace_class
from tidemark.functions.url import NETLOC_SCHEMES, TRACKING_PREFIX, URL_PARTS
from tidemark.operators.classify import compile_taxonomy, normalized


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS = whitespace_class()


def fold(e: str) -> str:
    # Sharp s is the only fold beyond lower() that occurs in the driver data.
    return f"replace(lower({e}), 'ß', 'ss')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(WS + '+')}, ' ', 'g'))"


def fold_text(e: str) -> str:
    return collapse(fold(f"coalesce({e}, '')"))


def match_key(e: str) -> str:
    inner = fold("coalesce(" + e + ", '')")
    return f"regexp_replace({inner}, {q(MATCH_KEY_DROP)}, '', 'g')"


def iso_date(e: str) -> str:
    return (f"CASE WHEN regexp_matches(substr({e}, 1, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') "
            f"THEN CAST(try_strptime(substr({e}, 1, 10), '%Y-%m-%d') AS DATE) "
            f"WHEN regexp_matches(substr({e}, 1, 10), '^[0-9]{{8}}$') THEN CAST(try_strptime(substr({e}, 1, 10), '%Y%m%d') AS DATE) END")


def canonical_url(e: str) -> str:
    s = f"regexp_replace(regexp_replace({e}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g'), '[\\t\\r\\n]', '', 'g')"
    pat = q(URL_PARTS)
    scheme = f"lower(regexp_extract({s}, {pat}, 1))"
    netloc = f"lower(regexp_extract({s}, {pat}, 2))"
    path0 = f"regexp_replace(regexp_extract({s}, {pat}, 3), '/+$', '')"
    path = f"(CASE WHEN {path0} = '' THEN '/' ELSE {path0} END)"
    query = f"regexp_extract({s}, {pat}, 4)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT "
            f"regexp_matches(lower(split_part(p, '=', 1)), {q(TRACKING_PREFIX)})), '&')")
    schemes = ", ".join(q(x) for x in NETLOC_SCHEMES)
    body = (f"(CASE WHEN {netloc} <> '' THEN '//' || {netloc} || {path} "
            f"WHEN starts_with({path}, '//') THEN '//' || {path} "
            f"WHEN {scheme} IN ({schemes}) AND starts_with({path}, '/') THEN '//' || {path} ELSE {path} END)")
    with_scheme = f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' || {body} ELSE {body} END)"
    return f"(CASE WHEN {e} IS NULL THEN NULL WHEN {kept} <> '' THEN {with_scheme} || '?' || {kept} ELSE {with_scheme} END)"


def _re_escape(needle: str) -> str:
    return "".join("\\" + c if c in ".+" else c for c in needle)


def keyword_hit(text: str, word: str) -> str:
    needle = normalized(word)
    if not needle:
        return "false"
    import re
    if re.fullmatch(r"[a-z0-9][a-z0-9 .+_-]*", needle):
        return f"regexp_matches({text}, {q('(^|[^a-z0-9])' + _re_escape(needle) + '($|[^a-z0-9])')})"
    return f"contains({text}, {q(needle)})"


def _any(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")" if parts else "false"


def _list(items: list[str]) -> str:
    if not items:
        return "CAST([] AS VARCHAR[])"
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def classify_ctes(src: str, taxonomy: dict, prefix: str = "k") -> tuple[str, str]:
    """CTEs adding primary_type, field_tags, audience_tags, score, reasons,
    decision, is_adjacent to relation ``src``; returns (ctes, final name)."""
    tax = compile_taxonomy(taxonomy)
    words = tax.all_keywords
    tf = {w: f"kt{i}" for i, w in enumerate(words)}
    cf = {w: f"kc{i}" for i, w in enumerate(words)}
    comb = "concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in (
        "title", "summary", "body_text", "original_category", "eligibility", "benefits")) + ")"
    c0 = f"{prefix}0 AS (SELECT *, {fold_text('title')} AS title_f, {fold_text(comb)} AS comb_f, {fold_text('original_category')} AS cat_f FROM {src})"
    flags = ", ".join([f"{keyword_hit('title_f', w)} AS {tf[w]}" for w in words] + [f"{keyword_hit('comb_f', w)} AS {cf[w]}" for w in words])
    c1 = f"{prefix}1 AS (SELECT *, {flags} FROM {prefix}0)"
    title_type = [(t, _any([tf[w] for w in kws])) for t, kws in tax.types if kws]
    comb_type = [(t, _any([cf[w] for w in kws])) for t, kws in tax.types if kws]
    primary = "CASE " + " ".join(f"WHEN {c} THEN {q(t)}" for t, c in title_type + comb_type) + " ELSE 'other' END"
    type_score = f"CASE WHEN {_any([c for _, c in title_type])} THEN 20 WHEN {_any([c for _, c in comb_type])} THEN 10 ELSE 0 END"
    field_tags = _list([f"CASE WHEN {_any([cf[w] for w in kws])} THEN {q(lab)} END" for _, lab, kws in tax.fields])
    aud_tags = _list([f"CASE WHEN {_any([cf[w] for w in kws])} THEN {q(lab)} END" for _, lab, kws in tax.audiences])
    fwords = [w for _, _, kws in tax.fields for w in kws]
    title_hits = "list_distinct(" + _list([f"CASE WHEN {tf[w]} THEN {q(w)} END" for w in fwords]) + ")"
    body_hits = "list_distinct(" + _list([f"CASE WHEN {cf[w]} THEN {q(w)} END" for w in fwords]) + ")"
    excluded = _list([f"CASE WHEN {cf[w]} THEN {q(w)} END" for w in tax.excludes])
    cat_fmt = _any([f"contains(cat_f, {q(p)})" for p in tx.CATEGORY_FORMAT_PHRASES])
    c2 = (f"{prefix}2 AS (SELECT *, {primary} AS primary_type, {type_score} AS type_score, {field_tags} AS field_tags, "
          f"{aud_tags} AS audience_tags, {title_hits} AS title_hits, {body_hits} AS body_hits, {excluded} AS excluded, "
          f"{cat_fmt} AS cat_fmt FROM {prefix}1)")
    strong = _any([f"contains(comb_f, {q(p)})" for p in tx.STRONG_FORMAT_PHRASES] + ["(primary_type = 'hackathon' AND type_score = 20)"])
    c3 = f"{prefix}3 AS (SELECT *, {strong} AS strong FROM {prefix}2)"
    kind = "coalesce(source_kind, '')"
    raw = (f"(CASE WHEN len(title_hits) > 0 THEN least(50, 35 + 5 * len(title_hits)) ELSE 0 END"
           f" + CASE WHEN len(body_hits) > 0 THEN least(30, 15 + 3 * len(body_hits)) ELSE 0 END"
           f" + CASE WHEN type_score > 0 THEN 12 ELSE 0 END"
           f" + CASE WHEN {kind} = 'specialist' THEN 35 WHEN {kind} = 'official' AND len(field_tags) > 0 THEN 10 ELSE 0 END"
           f" + CASE WHEN cat_fmt THEN 55 WHEN strong THEN 15 ELSE 0 END"
           f" - CASE WHEN len(excluded) > 0 THEN 55 ELSE 0 END)")
    c4 = f"{prefix}4 AS (SELECT *, {raw} AS raw_score FROM {prefix}3)"
    capped = "(len(title_hits) = 0 AND NOT strong AND NOT cat_fmt AND raw_score >= 70)"
    c5 = f"{prefix}5 AS (SELECT *, {capped} AS capped, greatest(0, least(100, CASE WHEN {capped} THEN 69 ELSE raw_score END)) AS score FROM {prefix}4)"

    def first_sorted(col: str) -> str:
        return f"array_to_string(list_slice(list_sort({col}), 1, 4), ', ')"

    reasons = _list([
        f"CASE WHEN len(title_hits) > 0 THEN {q(tx.REASON_TITLE)} || {first_sorted('title_hits')} END",
        f"CASE WHEN len(body_hits) > 0 THEN {q(tx.REASON_BODY)} || {first_sorted('body_hits')} END",
        f"CASE WHEN type_score > 0 THEN {q(tx.REASON_TYPE)} || primary_type END",
        f"CASE WHEN {kind} = 'specialist' THEN {q(tx.REASON_SPECIALIST)} WHEN {kind} = 'official' AND len(field_tags) > 0 THEN {q(tx.REASON_OFFICIAL)} END",
        f"CASE WHEN cat_fmt THEN {q(tx.REASON_CATEGORY)} WHEN strong THEN {q(tx.REASON_STRONG)} END",
        f"CASE WHEN len(excluded) > 0 THEN {q(tx.REASON_EXCLUDED)} || array_to_string(list_slice(excluded, 1, 3), ', ') END",
        f"CASE WHEN capped THEN {q(tx.REASON_NO_DIRECT)} END",
    ])
    c6 = (f"{prefix}6 AS (SELECT *, {reasons} AS reasons0, "
          f"CASE WHEN score >= 70 THEN 'publish' WHEN score >= 50 THEN 'review' ELSE 'exclude' END AS decision, "
          f"(primary_type = 'employment' OR (primary_type = 'education' AND coalesce(fee, '') = 'paid')) AS is_adjacent FROM {prefix}5)")
    c7 = f"{prefix}7 AS (SELECT *, CASE WHEN len(reasons0) = 0 THEN [{q(tx.REASON_NONE)}] ELSE reasons0 END AS reasons FROM {prefix}6)"
    return ",\n".join([c0, c1, c2, c3, c4, c5, c6, c7]), f"{prefix}7"


def status_exprs(start: str, end: str, kind: str, today: str) -> tuple[str, str]:
    s, e = iso_date(start), iso_date(end)
    dd = f"CAST(({e}) - DATE '{today}' AS BIGINT)"
    status = (f"CASE WHEN coalesce({kind}, '') = 'ongoing' THEN 'ongoing' WHEN ({e}) IS NULL THEN 'unknown' "
              f"WHEN ({s}) IS NOT NULL AND DATE '{today}' < ({s}) THEN 'upcoming' WHEN {dd} < 0 THEN 'closed' "
              f"WHEN {dd} = 0 THEN 'today' WHEN {dd} <= 3 THEN 'urgent' ELSE 'open' END")
    d_day = f"CASE WHEN coalesce({kind}, '') = 'ongoing' OR ({e}) IS NULL THEN NULL ELSE {dd} END"
    return status, d_day


RAW_CONSTANTS = ("'' AS eligibility, '' AS benefits, '' AS original_category, '' AS location, '' AS mode, "
                 "CAST(NULL AS VARCHAR) AS application_url, CAST(NULL AS VARCHAR) AS document_url, "
                 "CAST(NULL AS VARCHAR) AS event_start, CAST(NULL AS VARCHAR) AS event_end, CAST(NULL AS VARCHAR) AS collected_at")


def summary_expr() -> str:
    v0 = collapse("coalesce(summary, '')")
    v1 = f"(CASE WHEN {v0} = '' OR {v0} = coalesce(title, '') THEN {q(tx.SUMMARY_DEFAULT)} ELSE {v0} END)"
    pre = "coalesce(nullif(eligibility, ''), nullif(benefits, ''))"
    v2 = f"(CASE WHEN length({v1}) < 60 AND {pre} IS NOT NULL THEN {v1} || '. ' || {pre} ELSE {v1} END)"
    v3 = f"(CASE WHEN length({v2}) < 60 THEN {v2} || {q('. ' + tx.SUMMARY_PADDING)} ELSE {v2} END)"
    return f"substr({v3}, 1, 180)"


def organizer_expr() -> str:
    v = collapse("coalesce(organizer, '')")
    return f"(CASE WHEN {v} = '' THEN source_name ELSE {v} END)"


def title_expr() -> str:
    collapsed = f"regexp_replace(title, {q(WS + '+')}, ' ', 'g')"
    return f"trim(regexp_replace({collapsed}, {q('^(?:[>' + chr(0xFF5C) + '|' + chr(0xB7) + ']|' + WS + ')+')}, ''))"


def stable_id_expr() -> str:
    return f"substr(sha256(coalesce(source_id, '') || ':' || coalesce(nullif(source_post_id, ''), {canonical_url('source_url')})), 1, 20)"


def dedupe_key_expr() -> str:
    return f"concat_ws('|', {match_key('title')}, {match_key(organizer_expr())}, coalesce(recruit_end, ''))"


def normalized_ctes(taxonomy: dict, today: str, now_iso: str, src: str = "listings_v", prefix: str = "k") -> tuple[str, str]:
    """Raw listings -> scored, normalised scalar columns (``n`` relation)."""
    raw = f"{prefix}raw AS (SELECT *, {RAW_CONSTANTS} FROM {src})"
    cls, last = classify_ctes(f"{prefix}raw", taxonomy, prefix)
    status, d_day = status_exprs("recruit_start", "recruit_end", "date_kind", today)
    norm = (f"{prefix}n AS (SELECT ingest_seq, {stable_id_expr()} AS id, {title_expr()} AS title_c, title AS raw_title, source_id, source_name, "
            f"{canonical_url('source_url')} AS source_url_c, {organizer_expr()} AS organizer_c, {summary_expr()} AS summary_c, "
            f"primary_type, field_tags, audience_tags, {status} AS status, CAST({d_day} AS BIGINT) AS d_day, score, reasons, decision, "
            f"is_adjacent, {dedupe_key_expr()} AS dedupe_key, recruit_start, recruit_end, date_kind, fee, source_kind, source_priority, "
            f"source_post_id, {q(now_iso)} AS first_seen_at FROM {last})")
    return ",\n".join([raw, cls, norm]), f"{prefix}n"
