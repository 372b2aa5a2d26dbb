import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.shapes import document_faults
from tidemark.operators import quality
from tidemark.schema import LISTING_SHAPE, PUBLISHED_SHAPE, REREAD_SHAPE
from tidemark.sources import snapshot as snap

GOOD = {
    "id": "abcdefgh", "title": "T", "source_name": "N", "source_url": "https://x.example.org/1", "organizer": "O", "summary": "s" * 60,
    "primary_type": "contest", "field_tags": ["a"], "audience_tags": [], "status": "open", "relevance": {"score": 80, "reasons": ["r"], "decision": "publish"},
    "first_seen_at": "2024-01-01T00:00:00+09:00", "last_seen_at": "2024-01-01T00:00:00+09:00", "date_kind": "exact",
    "sources": [{"source_id": "s", "source_name": "N", "source_url": "https://x.example.org/1", "kind": "k", "priority": 1}],
}


def changed(**how):
    """GOOD with values set by path (``__`` goes down, a digit is an element); ``...`` removes."""
    doc = json.loads(json.dumps(GOOD))
    for path, value in how.items():
        *down, last = path.split("__")
        at = doc
        for p in down:
            at = at[int(p)] if p.isdigit() else at[p]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return doc


CASES = [
    (changed(), []),
    (changed(extra=1), [("extra", "unknown_key")]),
    (changed(relevance__extra=1), [("relevance.extra", "unknown_key")]),
    (changed(sources__0__more={"a": 1}), [("sources[].more", "unknown_key")]),
    (changed(title=...), [("title", "missing_key")]),
    (changed(relevance__score=...), [("relevance.score", "missing_key")]),
    (changed(sources__0__source_url=...), [("sources[].source_url", "missing_key")]),
    (changed(title=5), [("title", "wrong_type")]),
    (changed(title=None), [("title", "wrong_type")]),
    (changed(relevance=[]), [("relevance", "wrong_type")]),
    (changed(relevance="x"), [("relevance", "wrong_type")]),
    (changed(sources={"source_id": "s"}), [("sources", "wrong_type")]),
    (changed(sources=["s"]), [("sources[]", "wrong_type")]),
    (changed(field_tags=["a", 1, None]), [("field_tags[]", "wrong_type"), ("field_tags[]", "wrong_type")]),
    (changed(d_day=None, recruit_end=None, is_adjacent=True), []),
    (changed(d_day="3", is_adjacent="no"), [("d_day", "wrong_type"), ("is_adjacent", "wrong_type")]),
    (changed(relevance__score=80.5), [("relevance.score", "wrong_type")]),
]


def run(spark, shape, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n long, value string")
    rows = df.select("n", document_faults(shape, F.col("value")).alias("f")).collect()
    return [sorted((x["path"], x["fault"]) for x in r["f"]) for r in sorted(rows, key=lambda r: r["n"])]


def test_faults_by_path(spark):
    got = run(spark, LISTING_SHAPE, [json.dumps(doc) for doc, _ in CASES])
    assert got == [sorted(want) for _, want in CASES]


def test_only_top_level_keys_may_be_unknown_on_rereading(spark):
    got = run(spark, REREAD_SHAPE, [json.dumps(doc) for doc, _ in CASES])
    assert got == [sorted(w for w in want if w != ("extra", "unknown_key")) for _, want in CASES]


@pytest.mark.parametrize("text", ["", "{", "not json", "{\"a\": 1, \"a\": 2}"])
def test_no_documents(spark, text):
    assert run(spark, LISTING_SHAPE, [text]) == [[("$", "not_json")]]


def test_documents_that_are_no_records(spark):
    assert run(spark, LISTING_SHAPE, ["[]", "3", "null", "\"x\""]) == [[("$", "wrong_type")]] * 4


def test_published_limits(spark):
    docs = [changed(id="short"), changed(title=""), changed(summary="x" * 59), changed(summary="한" * 180), changed(summary="x" * 181), changed(status="later"),
            changed(relevance__score=101), changed(relevance__score=-1), changed(relevance__decision="maybe"), changed(sources=[]), changed(sources__0__kind=""),
            changed(sources__0__kind=...), changed(anything="else")]
    want = [("id", "too_short"), ("title", "too_short"), ("summary", "too_short"), None, ("summary", "too_long"), ("status", "not_listed"), ("relevance.score", "too_large"),
            ("relevance.score", "too_small"), ("relevance.decision", "not_listed"), ("sources", "too_short"), ("sources[].kind", "too_short"), ("sources[].kind", "missing_key"), None]
    assert run(spark, PUBLISHED_SHAPE, [json.dumps(d) for d in docs]) == [[w] if w else [] for w in want]


def test_rereading_skips_what_does_not_convert(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(doc) for doc, _ in CASES) + "\n\nnot json\n", encoding="utf-8")
    got = snap.read_listings(spark, f"file://{tmp_path}/a.json").collect()
    kept = [doc for doc, want in CASES if all(w == ("extra", "unknown_key") for w in want)]
    assert len(got) == len(kept) == 3
    assert {r["relevance"]["score"] for r in got} == {80} and {r["sources"][0]["kind"] for r in got} == {"k"}
    assert snap.read_listings(spark, f"file://{tmp_path}/none").count() == 0


def test_record_faults_keep_the_rows_columns(spark):
    lines = spark.createDataFrame([("a", json.dumps(changed(extra=1, title=...))), ("b", json.dumps(GOOD))], "k string, value string")
    got = sorted(map(tuple, quality.record_faults(lines, LISTING_SHAPE).collect()))
    assert got == [("a", "extra", "unknown_key"), ("a", "title", "missing_key")]


def test_a_document_is_parsed_and_its_objects_are_read_once(spark):
    made = str(document_faults(LISTING_SHAPE, F.col("value")))
    assert made.count("try_parse_json") == 1
    assert len(made) < 40_000          # grows with the keys of the shape, not with their product
