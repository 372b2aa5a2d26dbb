import uuid

from pyspark.sql import functions as F

from tidemark.plans.q_listings import TAX
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import fixtures as fx
from tidemark.sources import snapshot as snap
from tidemark.streaming.scheduled import land, run_refresh, scheduled_run

SF = "/root/testdata/sf0.001"


def _sources(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct()
    return docs.select(F.col("source").alias("id"), F.lit(True).alias("enabled"), F.lit("fast").alias("schedule"))


def test_available_now_equals_batch_run(spark):
    root = ensure_checkpoint_dir(spark).rstrip("/") + "/t-" + uuid.uuid4().hex
    raw = fx.listing_raw(spark, SF)
    land(raw, f"{root}/landing", "one", "all")
    sources = _sources(spark)
    failed = spark.createDataFrame([], "source_id string")
    run_refresh(spark, f"{root}/landing", f"{root}/out", f"{root}/ckpt",
                sources, failed, TAX, lambda e: (fx.NOW_ISO, fx.LISTING_TODAY))
    streamed = {(r.dataset, r.rank, r.id) for r in snap.read_published(spark, f"{root}/out").collect()}
    batch = {(r.dataset, r.rank, r.id) for r in scheduled_run(raw, None, sources, "all", failed, TAX, fx.NOW_ISO, fx.LISTING_TODAY).collect()}
    assert streamed == batch and streamed


def test_second_run_keeps_first_seen(spark):
    root = ensure_checkpoint_dir(spark).rstrip("/") + "/t-" + uuid.uuid4().hex
    raw = fx.listing_raw(spark, SF).repartition(3)
    land(raw, f"{root}/landing", "first", "all")
    land(raw, f"{root}/landing", "second", "all")
    stamps = {0: ("2024-01-30T12:00:00+09:00", "2024-01-30"), 1: (fx.NOW_ISO, fx.LISTING_TODAY)}
    run_refresh(spark, f"{root}/landing", f"{root}/out", f"{root}/ckpt", _sources(spark),
                spark.createDataFrame([], "source_id string"), TAX, lambda e: stamps[e])
    out = snap.read_published(spark, f"{root}/out").collect()
    assert out
    # every listing was already seen by the first run
    assert {r.first_seen_at for r in out} == {"2024-01-30T12:00:00+09:00"}
    assert all(r.last_seen_at == fx.NOW_ISO for r in out)
    # idempotence: the same input again changes nothing
    assert all(len(r.change_flags) == 0 and r.last_changed_at is None for r in out)


class Killed(Exception):
    pass


def test_replayed_batch_is_published_once(spark, monkeypatch):
    import pytest

    from tidemark.operators import publish as pub
    from tidemark.operators.normalize import normalize
    from tidemark.streaming import scheduled
    raw = fx.listing_raw(spark, SF).where("ingest_seq < 40")

    def light_run(rows, previous, sources, schedule, failed, taxonomy, now_iso, today):
        """Scored rows only; each notes how many rows the run before had."""
        before = 0 if previous is None else previous.count()
        items = normalize(rows, taxonomy, now_iso, today).withColumn("change_flags", F.array(F.lit(str(before))))
        return pub.dataset_rank(pub.partition_listings(items.checkpoint(), today))

    monkeypatch.setattr(scheduled, "scheduled_run", light_run)
    stamps = {0: ("2024-01-30T12:00:00+09:00", "2024-01-30"), 1: (fx.NOW_ISO, fx.LISTING_TODAY)}

    def refresh(root):
        run_refresh(spark, f"{root}/landing", f"{root}/out", f"{root}/ckpt", _sources(spark), spark.createDataFrame([], "source_id string"), TAX, lambda e: stamps[e])

    def published(root):
        return sorted((r.dataset, r.rank, r.id, r.first_seen_at, r.last_seen_at, tuple(r.change_flags)) for r in snap.read_published(spark, f"{root}/out").collect())

    roots = [ensure_checkpoint_dir(spark).rstrip("/") + "/t-" + uuid.uuid4().hex for _ in range(2)]
    for root in roots:
        land(raw.where("ingest_seq % 2 = 0"), f"{root}/landing", "first", "all")
        refresh(root)
        land(raw, f"{root}/landing", "second", "all")
    publish = snap.publish_manifest
    with monkeypatch.context() as m:      # the rows are written, the entry is not
        m.setattr(snap, "publish_manifest", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Exception):
            refresh(roots[0])
    assert snap.latest_manifest(spark, f"{roots[0]}/out")["run"] == "run-0-first"
    with monkeypatch.context() as m:      # the entry is written, the batch is not committed
        m.setattr(snap, "publish_manifest", lambda *a: (publish(*a), (_ for _ in ()).throw(Killed()))[1])
        with pytest.raises(Exception):
            refresh(roots[0])
    for root in roots:
        refresh(root)
    last = snap.latest_manifest(spark, f"{roots[0]}/out")
    assert (last["run"], last["seq"], last["parent"]) == ("run-1-second", 2, "run-0-first")
    assert published(roots[0]) == published(roots[1]) and published(roots[0])


def test_ledger_orders_runs_by_number(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    for run, stamp in (("run-2", "2024-01-31T12:00:00+09:00"), ("run-10", "2024-01-31T03:30:00+00:00"), ("run-9", "2024-01-31T12:00:00+09:00")):
        snap.publish_manifest(spark, root, run, stamp)
    assert snap.latest_manifest(spark, root)["run"] == "run-9"
    snap.publish_manifest(spark, root, "run-2", "2024-02-01T00:00:00+00:00")     # entered again: keeps its number
    assert snap.latest_manifest(spark, root)["run"] == "run-9" and snap.manifest_of(spark, root, "run-2")["seq"] == 1


def test_scheduled_run_does_not_shuffle_raw_listings(spark, monkeypatch):
    from tidemark.streaming import scheduled
    monkeypatch.setattr(scheduled.pipeline, "run", lambda inp: inp.raw)
    raw = spark.createDataFrame([("a", "text"), ("b", "text"), ("c", "text")], "source_id string, body_text string")
    sources = spark.createDataFrame([("a", True, "fast"), ("b", True, "slow"), ("c", True, "fast")], "id string, enabled boolean, schedule string")
    failed = spark.createDataFrame([("c",)], "source_id string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # tables whose size is not known before they are worked out
    try:
        out = scheduled.scheduled_run(raw, None, sources, "fast", failed, {}, "", "")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert [r.source_id for r in out.collect()] == ["a"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
