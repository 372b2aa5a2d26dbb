import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import taxonomy as tx
from tidemark.operators import facets, search
from tidemark.operators.query import search_terms
from tidemark.plans import q_query
from tidemark.sources import published

SF = "/root/testdata/sf0.001"
PIECES = ["게임", "공모전", "인디 게임", "the", "and", "THE", "a", "ab", "É", "😀", "straße", " ", "x", "zz", "\x00", "中文", "%", "_", "'"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [(i * 3 + 1, rng.choice([" ", ""]).join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 2, 8, 60])))) for i in range(400)]
    return [*made, (10_000, None), (10_001, "the " * 3000)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    return search.build_index(df, "k", F.col("t"), f"file://{tmp_path_factory.mktemp('index')}/i", parts=8)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("query", ["the", "게임", "게", "인디 게임", "a", "É", "é", "ab the", "zz x 게임", "absent-term", "q", "qq", "th", "😀", "😀 a", "%", "_", "'", "\x00", "straße", "",
                                   "the the", "게임공모전", "中", "e t", "HE"])
def test_search_equals_brute_force(index, rows, query):
    terms = search_terms(query)
    assert ids(index.search(terms)) == sorted(k for k, t in rows if all(w in (t or "").lower() for w in terms))


def test_every_term_of_two_letters(index, rows):
    terms = {t[i:i + 2].lower() for _, t in rows if t for i in range(0, min(len(t) - 1, 12), 5)}
    for term in sorted(t for t in terms if not t.isspace() and len(t.strip()) == 2)[:12]:
        assert ids(index.search([term])) == sorted(k for k, t in rows if term in (t or "").lower())


def test_search_reads_parts_of_its_grams(index):
    plan = index.candidates(["the"])._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet"):]
    assert "part#" in scan[scan.index("PartitionFilters: ["):scan.index("PushedFilters: [")]
    assert "gram" in scan[scan.index("PushedFilters: ["):]


def test_texts_are_pruned_to_blocks(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("row number "), F.col("id").cast("string")).alias("t"))
    old = search.BLOCK_ROWS
    search.BLOCK_ROWS = 100
    try:
        index = search.build_index(df, "k", F.col("t"), f"file://{tmp_path}/i")
    finally:
        search.BLOCK_ROWS = old
    assert index.blocks == 30
    found = index.search(["number 1234"])
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert ids(found) == [1234]


def brute_cube(listings):
    """Counts over every combination, from plain rows."""
    out = {}
    for r in listings:
        for d in (r["dataset"] or "", "*"):
            for t in (r["primary_type"], "*"):
                for s in (r["status"], "*"):
                    for f in [*dict.fromkeys(r["field_tags"]), "*"]:
                        for q in [*r["quicks"], "*"]:
                            key = (d, t, r["is_adjacent"], s, f, q)
                            out[key] = out.get(key, 0) + 1
    return out


def listings(spark, seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["active", "closed", None]), rng.choice(tx.TYPES[:3]), rng.random() < 0.2, rng.choice(["open", "closed"]),
             rng.sample(["게임", "AI", "인디"], rng.randint(0, 3)), rng.sample(["대학생"], rng.randint(0, 1)), rng.choice([None, -1, 0, 7, 8]),
             f"2024-01-{rng.randint(1, 31):02d} 00:00:00") for i in range(n) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "ingest_seq long, dataset string, primary_type string, is_adjacent boolean, status string, field_tags array<string>, "
                                     "audience_tags array<string>, d_day int, first_seen_ts string")
    return df.withColumns({"first_seen_ts": F.to_timestamp("first_seen_ts"), "last_changed_ts": F.lit(None).cast("timestamp")})


def as_dict(cube):
    return {tuple(r[c] for c in facets.DIMS): r["n"] for r in cube.collect()}


def test_cube_equals_counting(spark):
    df, now = listings(spark, 1, 200), F.lit("2024-01-20 00:00:00").cast("timestamp")
    rows = df.withColumn("quicks", facets.quick_tags(now)).collect()
    assert as_dict(facets.facet_cube(df, now)) == brute_cube(rows)
    assert as_dict(facets.facet_cube(df.limit(0), now)) == {}


def test_cube_follows_a_run_by_the_difference(spark):
    old, new = listings(spark, 1, 200), listings(spark, 2, 260)
    then, now = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp") for d in (15, 20))
    got = facets.update_cube(facets.facet_cube(old, then), old, then, new, now, "ingest_seq")
    assert as_dict(got) == as_dict(facets.facet_cube(new, now))
    same = facets.update_cube(facets.facet_cube(old, then), old, then, old, then, "ingest_seq")
    assert as_dict(same) == as_dict(facets.facet_cube(old, then))


def test_run_is_written_once_and_pruned(spark):
    run = q_query.run_of(spark, SF)
    assert q_query.run_of(spark, SF).path == run.path
    assert published.open_published(spark, run.path + "-none") is None
    plan = q_query.q_dataset_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "summary" not in plan and "sources" not in plan
    plan = q_query.q_filter_listings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "summary" not in plan
    plan = q_query.q_freshness(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<dataset:string,primary_type:string,status:string,field:string,quick:string,n:bigint>" in plan and plan.count("FileScan") == 1
