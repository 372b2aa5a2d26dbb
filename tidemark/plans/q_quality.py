"""Data-quality queries (V1-V14, S2) over the routed listings, over a run that
breaks each rule, and over JSON records with faults at every level."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.config import taxonomy as tx
from tidemark.operators import quality
from tidemark.plans import sqlgen as sg
from tidemark.plans.catalog import register
from tidemark.plans.q_query import SCORED_SQL, scored
from tidemark.schema import LISTING_SHAPE, PUBLISHED_SHAPE
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import fixtures as fx
from tidemark.sources import snapshot
from tidemark.sources.tables import table

HTTP = "(regexp_matches({c}, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]+'))"


def _http(c: str) -> str:
    return f"(coalesce({c}, '') = '' OR {HTTP.format(c=c)})"


VIOLATIONS_SQL = SCORED_SQL + f"""
, pub AS (SELECT * FROM sc WHERE dataset IS NOT NULL),
rules AS (
  SELECT dataset, ingest_seq AS row, list_filter([
    CASE WHEN row_number() OVER (PARTITION BY id ORDER BY CASE dataset WHEN 'active' THEN 0 WHEN 'undated' THEN 1 WHEN 'closed' THEN 2 ELSE 3 END, ingest_seq) > 1 THEN 'V7_duplicate_id' END,
    CASE WHEN trim(coalesce(title, '')) = '' OR coalesce(source_url_c, '') = '' OR NOT {_http('source_url_c')} THEN 'V8_title_or_url' END,
    CASE WHEN length(summary) NOT BETWEEN 60 AND 180 THEN 'V9_summary_length' END,
    CASE WHEN NOT ({_http('source_url_c')} AND coalesce(source_id, '') <> '' AND coalesce(source_name, '') <> '') THEN 'V10_sources' END,
    CASE WHEN decision = 'publish' AND score < 70 OR decision = 'review' AND score NOT BETWEEN 50 AND 69 THEN 'V13_score_decision' END,
    CASE WHEN length(id) < 8 OR score NOT BETWEEN 0 AND 100 OR coalesce(organizer, '') = '' THEN 'V14_schema_extras' END
  ], lambda x: x IS NOT NULL) AS failed FROM pub)
""".replace("\n, pub AS", ",\npub AS")


@register("dq_violations", VIOLATIONS_SQL + "SELECT dataset, row, unnest(failed) AS rule FROM rules")
def q_dq_violations(spark, sf):
    s = scored(spark, sf).where(F.col("dataset").isNotNull())
    return quality.violations(s)


@register("dq_rule_counts", VIOLATIONS_SQL + "SELECT rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(failed) AS rule FROM rules) GROUP BY rule")
def q_dq_rule_counts(spark, sf):
    s = scored(spark, sf).where(F.col("dataset").isNotNull())
    return quality.violations(s).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# ---- V7-V13 on a run in which Spark breaks each rule on some rows
BROKEN = {
    "id": "CASE WHEN ingest_seq % 10 = 3 THEN concat('dup-', CAST(ingest_seq % 40 AS STRING)) WHEN ingest_seq % 71 = 0 THEN 'short' ELSE id END",
    "title": "CASE WHEN ingest_seq % 13 = 0 THEN '   ' ELSE title END",
    "source_url": "CASE WHEN ingest_seq % 17 = 0 THEN 'ftp://files.example.org/x' WHEN ingest_seq % 19 = 0 THEN '' ELSE source_url END",
    "organizer": "CASE WHEN ingest_seq % 67 = 0 THEN '' ELSE organizer END",
    "summary": "CASE WHEN ingest_seq % 11 = 0 THEN 'too short' WHEN ingest_seq % 12 = 0 THEN concat(summary, repeat('x', 181)) ELSE summary END",
    "primary_type": "CASE WHEN ingest_seq % 23 = 0 THEN 'movie' ELSE primary_type END",
    "status": "CASE WHEN ingest_seq % 29 = 0 THEN 'later' ELSE status END",
    "date_kind": "CASE WHEN ingest_seq % 31 = 0 THEN 'soon' ELSE date_kind END",
    "first_seen_at": "CASE WHEN ingest_seq % 43 = 0 THEN 'yesterday' ELSE first_seen_at END",
    "last_seen_at": "CASE WHEN ingest_seq % 47 = 0 THEN '' ELSE last_seen_at END",
    "last_changed_at": "CASE WHEN ingest_seq % 53 = 0 THEN 'bad' WHEN ingest_seq % 54 = 0 THEN '2024-01-01T00:00:00+09:00' ELSE last_changed_at END",
    "application_url": "CASE WHEN ingest_seq % 59 = 0 THEN 'javascript:alert(1)' WHEN ingest_seq % 60 = 0 THEN 'https://ok.example.org' ELSE application_url END",
    "document_url": "CASE WHEN ingest_seq % 61 = 0 THEN 'https://' ELSE document_url END",
    "score": "CASE WHEN ingest_seq % 37 = 0 THEN 40 WHEN ingest_seq % 38 = 0 THEN 101 ELSE score END",
}
# what a listing's first source is: 0 none at all, 1 without a name, 2 with a bad URL, 3 as it was
BROKEN_SOURCE = "CASE WHEN ingest_seq % 41 = 0 THEN 0 WHEN ingest_seq % 73 = 0 THEN 1 WHEN ingest_seq % 79 = 0 THEN 2 ELSE 3 END"


def broken_run(spark, sf):
    """The published listings with values replaced so that every rule fails somewhere."""
    s = scored(spark, sf).where(F.col("dataset").isNotNull())
    first = F.col("sources")[0]
    bad = (F.when(F.expr(BROKEN_SOURCE) == 0, F.slice("sources", 1, 0))
           .when(F.expr(BROKEN_SOURCE) == 1, F.array(first.withField("source_name", F.lit(""))))
           .when(F.expr(BROKEN_SOURCE) == 2, F.array(first.withField("source_url", F.lit("file:///etc"))))
           .otherwise(F.col("sources")))
    out = s.withColumns({"sources": bad, **{c: F.expr(e) for c, e in BROKEN.items()}})
    return out.withColumn("relevance", F.col("relevance").withField("score", F.col("score").cast("int")))


def _ts_sql(c: str) -> str:
    return f"TRY_CAST({c} AS TIMESTAMPTZ) IS NOT NULL"


def _broken_sql() -> str:
    cols = {"id": "id", "title": "title", "source_url": "source_url_c", "organizer": "organizer", "summary": "summary", "primary_type": "primary_type", "status": "status",
            "date_kind": "date_kind", "first_seen_at": "first_seen_at", "last_seen_at": "first_seen_at", "last_changed_at": "NULL", "application_url": "NULL",
            "document_url": "NULL", "score": "score"}
    made = ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in BROKEN.items())
    enum = lambda c, values: f"coalesce({c} NOT IN (" + ", ".join(sg.q(v) for v in values) + "), true)"
    return SCORED_SQL + f"""
, base AS (SELECT ingest_seq, dataset, decision, source_id, source_name, source_url_c AS first_url, {", ".join(f"{v} AS {k}" for k, v in cols.items())} FROM sc WHERE dataset IS NOT NULL),
br AS (SELECT ingest_seq, dataset, decision, source_id, source_name, first_url, {BROKEN_SOURCE} AS source_case, {made} FROM base),
rules AS (
  SELECT dataset, ingest_seq AS row, list_filter([
    CASE WHEN row_number() OVER (PARTITION BY id ORDER BY CASE dataset WHEN 'active' THEN 0 WHEN 'undated' THEN 1 WHEN 'closed' THEN 2 ELSE 3 END, ingest_seq) > 1 THEN 'V7_duplicate_id' END,
    CASE WHEN trim(title) = '' OR source_url = '' OR NOT {_http('source_url')} THEN 'V8_title_or_url' END,
    CASE WHEN {enum('primary_type', tx.TYPES)} OR {enum('status', tx.STATUSES)} OR {enum('date_kind', tx.DATE_KINDS)} THEN 'V8_enums' END,
    CASE WHEN length(summary) NOT BETWEEN 60 AND 180 THEN 'V9_summary_length' END,
    CASE WHEN source_case < 3 OR NOT ({_http('first_url')} AND coalesce(source_id, '') <> '' AND coalesce(source_name, '') <> '') THEN 'V10_sources' END,
    CASE WHEN first_seen_at = '' OR NOT {_ts_sql('first_seen_at')} OR last_seen_at = '' OR NOT {_ts_sql('last_seen_at')}
           OR (coalesce(last_changed_at, '') <> '' AND NOT {_ts_sql('last_changed_at')}) THEN 'V11_seen_times' END,
    CASE WHEN NOT {_http('application_url')} OR NOT {_http('document_url')} THEN 'V12_optional_urls' END,
    CASE WHEN decision = 'publish' AND score < 70 OR decision = 'review' AND score NOT BETWEEN 50 AND 69 THEN 'V13_score_decision' END,
    CASE WHEN length(id) < 8 OR score NOT BETWEEN 0 AND 100 OR organizer = '' THEN 'V14_schema_extras' END
  ], lambda x: x IS NOT NULL) AS failed FROM br)
""".replace("\n, base AS", ",\nbase AS")


@register("dq_broken_violations", _broken_sql() + "SELECT dataset, row, unnest(failed) AS rule FROM rules")
def q_dq_broken_violations(spark, sf):
    """V7-V14 on a run that breaks each rule."""
    return quality.violations(broken_run(spark, sf))


@register("dq_broken_counts", _broken_sql() + "SELECT rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(failed) AS rule FROM rules) GROUP BY rule")
def q_dq_broken_counts(spark, sf):
    return quality.violations(broken_run(spark, sf)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# ---- S2, V6, V14 on JSON records that Spark derives from documents, with faults at every level
DOC = "CAST(doc_id AS VARCHAR)"
RECORD = (
    "concat('{\"id\":\"', CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE '' END, 'doc-', lpad({D}, CASE WHEN doc_id % 11 = 5 THEN 2 ELSE 8 END, '0'), '\",\"title\":', "
    "CASE doc_id % 13 WHEN 1 THEN '5' WHEN 2 THEN 'null' WHEN 3 THEN '\"\"' ELSE '\"T\"' END, ',\"source_name\":\"N\",\"source_url\":\"https://x.example.org/', {D}, "
    "'\",\"organizer\":\"O\",\"summary\":\"', repeat('s', CASE WHEN doc_id % 17 = 4 THEN 30 ELSE 60 END), '\",\"primary_type\":\"contest\",\"audience_tags\":[],\"status\":\"open\",', "
    "CASE WHEN doc_id % 19 = 6 THEN '' ELSE concat('\"field_tags\":[\"a\"', CASE WHEN doc_id % 7 = 3 THEN ',7' ELSE '' END, '],') END, "
    "'\"relevance\":{\"score\":', CASE WHEN doc_id % 29 = 8 THEN '\"80\"' ELSE '80' END, ',\"reasons\":[],\"decision\":\"publish\"', CASE WHEN doc_id % 5 = 2 THEN ',\"why\":{\"a\":[1]}' ELSE '' END, '},"
    "\"first_seen_at\":\"2024-01-01T00:00:00+09:00\",\"last_seen_at\":\"2024-01-01T00:00:00+09:00\",\"date_kind\":\"exact\",', CASE WHEN doc_id % 31 = 9 THEN '\"later_version\":true,' ELSE '' END, "
    "'\"sources\":[{\"source_id\":\"s\",\"source_name\":\"N\",', CASE WHEN doc_id % 37 = 10 THEN '' ELSE '\"source_url\":\"https://x.example.org/\",' END, '\"kind\":\"k\",\"priority\":1}', "
    "CASE WHEN doc_id % 41 = 11 THEN ',\"s2\"' ELSE '' END, ']', CASE WHEN doc_id % 43 = 12 THEN '' ELSE '}' END)"
).replace("{D}", DOC)
# (path, fault, when) of the closed shape; records that are cut off have one fault only
RECORD_FAULTS = (
    ("title", "wrong_type", "doc_id % 13 IN (1, 2)"), ("field_tags[]", "wrong_type", "doc_id % 7 = 3 AND doc_id % 19 <> 6"), ("field_tags", "missing_key", "doc_id % 19 = 6"),
    ("relevance.score", "wrong_type", "doc_id % 29 = 8"), ("relevance.why", "unknown_key", "doc_id % 5 = 2"), ("sources[].source_url", "missing_key", "doc_id % 37 = 10"),
    ("sources[]", "wrong_type", "doc_id % 41 = 11"),
)
CUT_OFF = "doc_id % 43 = 12"


def records(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(RECORD.replace("AS VARCHAR", "AS STRING")).alias("value"))


def _faults_sql(faults) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, '{path}' AS path, '{fault}' AS fault FROM documents WHERE {when} AND NOT ({CUT_OFF})" for path, fault, when in faults)
    return f"{rows} UNION ALL SELECT doc_id, '$', 'not_json' FROM documents WHERE {CUT_OFF}"


@register("record_faults", _faults_sql((*RECORD_FAULTS, ("later_version", "unknown_key", "doc_id % 31 = 9"))))
def q_record_faults(spark, sf):
    """V6: what keeps a record from converting, at every level of nesting."""
    return quality.record_faults(records(spark, sf), LISTING_SHAPE)


@register("published_schema_faults", _faults_sql((
    *(x for x in RECORD_FAULTS if x[0] != "relevance.why"), ("id", "too_short", "doc_id % 11 = 5 AND doc_id % 23 <> 0"),
    ("id", "too_short", "doc_id % 11 = 5 AND doc_id % 23 = 0"), ("title", "too_short", "doc_id % 13 = 3"), ("summary", "too_short", "doc_id % 17 = 4"))))
def q_published_schema_faults(spark, sf):
    """The published schema's limits, with the types and keys it requires."""
    return quality.record_faults(records(spark, sf), PUBLISHED_SHAPE)


@register("tolerant_reread", "SELECT CAST(CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE '' END || 'doc-' || lpad(CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 11 = 5 THEN 2 ELSE 8 END, '0') AS VARCHAR) AS id, "
          "CASE WHEN doc_id % 13 = 3 THEN '' ELSE 'T' END AS title, 80 AS score, 'https://x.example.org/' || CAST(doc_id AS VARCHAR) AS source_url FROM documents WHERE NOT ("
          + " OR ".join(f"({when})" for _, _, when in RECORD_FAULTS) + f" OR ({CUT_OFF}))")
def q_tolerant_reread(spark, sf):
    """Records written as JSON lines and read again; those that do not
    convert are skipped, unknown keys of a record itself are dropped."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reread-{uuid.uuid4().hex}"
    records(spark, sf).select("value").write.text(path)
    back = snapshot.read_listings(spark, path)
    return back.select("id", "title", F.col("relevance.score").alias("score"), "source_url")


# ---- V1-V6 and V14 over a written run; V5 over status rows
@register("dq_payload_rules", " UNION ALL ".join((
    "SELECT 'manifest' AS dataset, CAST(-1 AS BIGINT) AS row, 'V2_schema_version' AS rule", "SELECT 'manifest', -1, 'V3_generated_at'", "SELECT 'undated', -1, 'V1_missing'",
    "SELECT 'review', -1, 'V1_missing'",
    "SELECT CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'active' END, doc_id, 'V6_conversion' FROM documents WHERE doc_id % 31 = 9 OR "
    + " OR ".join(f"({w})" for _, _, w in RECORD_FAULTS),
    "SELECT CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'active' END, doc_id, 'V14_published_schema' FROM documents WHERE doc_id % 11 = 5 OR doc_id % 13 = 3 OR doc_id % 17 = 4 OR "
    + " OR ".join(f"({w})" for p, _, w in RECORD_FAULTS if p != "relevance.why"))))
def q_dq_payload_rules(spark, sf):
    """V1-V4, V6, V14 over a run written with a bad manifest, two datasets of
    four, and the derived records."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/payload-{uuid.uuid4().hex}"
    whole = F.when(F.expr(CUT_OFF), F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    ranked = F.concat(F.lit("{\"rank\":"), F.col("doc_id").cast("string"), F.lit(","), F.substring(whole, F.lit(2), F.length(whole)))
    rows = records(spark, sf).select(ranked.alias("value"), F.when(F.col("doc_id") % 3 == 0, "closed").otherwise("active").alias("dataset"))
    rows.write.partitionBy("dataset").text(f"{root}/runs/r1")
    manifest = spark.createDataFrame([(99, "not a time", "r1", list(snapshot.DATASETS), 1, None)], snapshot.MANIFEST_SCHEMA)
    manifest.write.json(f"{root}/_manifests/r1")
    return quality.payload_violations(spark, root)


@register("dq_status_rows", """
SELECT 'sources' AS dataset, CAST(run_seq AS BIGINT) AS row, 'V5_status' AS rule FROM run_log_v
WHERE run_seq % 9 = 0 OR CASE run_seq % 7 WHEN 0 THEN 'done' WHEN 1 THEN '' ELSE 'success' END NOT IN ('success', 'failed', 'skipped')""")
def q_dq_status_rows(spark, sf):
    """V5 over status rows of the run log, some without a source or with another state."""
    r = fx.run_log_v(spark, sf)
    states = F.when(F.col("run_seq") % 7 == 0, "done").when(F.col("run_seq") % 7 == 1, "").otherwise("success")
    rows = r.select("run_seq", F.when(F.col("run_seq") % 9 == 0, "").otherwise(F.col("source_id")).alias("source_id"), states.alias("status"))
    return quality.status_violations(rows, "run_seq")
