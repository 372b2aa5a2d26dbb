import pytest
from pyspark.sql import functions as F

from tidemark.operators.ordering import global_positions, top_page
from tidemark.operators.publish import dataset_rank


@pytest.mark.parametrize("partitions", [8, 16, 200])
def test_positions_are_exact_with_a_payload(spark, partitions, tmp_path):
    """More rows than a range partitioning samples whole, and columns beyond the order."""
    n = 1_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.col("id"), F.repeat(F.col("id").cast("string"), 8).alias("payload"))
    global_positions(df, [F.col("k"), F.col("id")], "pos", partitions).write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.count(F.lit(1))).head()[:] == (1, n, n, n)
    after = got.alias("a").join(got.alias("b"), F.col("a.pos") + 1 == F.col("b.pos")).where("a.k > b.k or (a.k = b.k and a.id >= b.id)")
    assert after.isEmpty()


def test_dataset_ranks_are_exact(spark):
    names = F.array(*[F.lit(d) for d in ("active", "undated", "closed", "review")])
    df = spark.range(400_000).select(
        F.col("id").alias("ingest_seq"), F.element_at(names, F.pmod(F.xxhash64("id"), F.lit(4)).cast("int") + 1).alias("dataset"),
        (F.xxhash64("id") % 300).cast("int").alias("d_day"), F.repeat(F.col("id").cast("string"), 6).alias("title"),
        F.struct((F.col("id") % 101).cast("int").alias("score")).alias("relevance"))
    ranks = dataset_rank(df).groupBy("dataset").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d"), F.count(F.lit(1)).alias("n"))
    for r in ranks.collect():
        assert (r.a, r.b, r.d) == (1, r.n, r.n)


def test_last_page_is_a_range_of_positions(spark):
    df = spark.range(10_001).select("id", F.repeat(F.lit("x"), 20).alias("payload"))
    rows, page, pages = top_page(df, [F.col("id").desc()], 10 ** 9, 50)
    assert (page, pages) == (201, 201) and [(r.id, r.pos) for r in rows.collect()] == [(0, 10_001)]
