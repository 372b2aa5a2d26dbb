"""Registered queries against their DuckDB oracles on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as se
from tidemark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["status_for", "parse_iso_date", "months_ago", "partition_dataset", "dataset_rank", "page_slice", "canonical_url",
        "match_key", "stable_id", "summary_contract", "dedupe_key", "normalize_listing", "score_reasons", "date_range_text",
        "exact_dup_edges", "dedupe_components", "identity_keys", "match_exact_id", "personal_restore", "failure_streak",
        "source_health", "type_tab_counts", "quick_tag_counts", "sort_relevance", "display_rows", "exclude_listings",
        "carry_forward", "source_counts", "match_weak_keys", "reconcile_history", "new_changed_counts", "apply_patches",
        "force_decisions", "manual_union", "first_sentence", "run_statuses", "short_dates", "feed_quota", "toggle_stream",
        "listing_json_roundtrip", "snapshot_write_read", "notice_table_orders", "list_layout_lineitem", "support_table_part",
        "range_table_customer", "detail_fallback_join", "link_candidates", "dday_list_orders"]


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, con, name):
    df = se.queries()[name](spark, SF)
    res = con.execute(se.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    a = sorted(tuple(canon(r[c]) for c in sorted(df.columns)) for r in df.collect())
    idx = [ocols.index(c) for c in sorted(ocols)]
    b = sorted(tuple(canon(r[i]) for i in idx) for r in res.fetchall())
    assert a == b


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() >= 0
    assert "dataset" in df.columns
