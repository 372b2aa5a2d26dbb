"""The stages against brute force on what each of them was given."""
import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline as cp
from tidemark.llm import decontaminate as D
from tidemark.llm import pieces, toxicity
from tidemark.llm.text import slices

from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_columns_and_no_repeats(kept):
    for rows in kept[1:5]:
        assert set(rows[0].asDict()) == set(cp.COLUMNS) and len(ids(rows)) == len(rows)
    assert ids(kept[5]) == ids(kept[4])


def test_toxic_documents_go(spark, kept):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = kept[0]
    score = np.concatenate([toxicity.score_slice(model, b) for b in slices(pa.array([r["text"] for r in rows], pa.string()))])
    assert ids(kept[1]) == {r["doc_id"] for r, s in zip(rows, score, strict=True) if s < 0.5}
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    clean = [r["doc_id"] for r in rows if toxic.get(r["doc_id"]) == 0]
    assert np.mean([d in ids(kept[1]) for d in clean]) > 0.95


def test_lines_near_duplicates_and_leaks_go(spark, kept):
    want = {d: t for d, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in kept[1]])}
    assert {r["doc_id"]: r["text"] or "" for r in kept[2]} == want
    assert ids(kept[3]) == {d for d, _, _, k in brute_groups([(r["doc_id"], r["text"]) for r in kept[2]], cp.LINK) if k}
    items = D.word_hashes([t for t, in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()])
    texts = D.word_hashes([r["text"] or "" for r in kept[3]])
    leaks = {r["doc_id"] for r, h in zip(kept[3], texts, strict=True) if any(len(x) >= 5 and D.edit_distance(x, h) <= D.allowed(len(x)) for x in items)}
    assert ids(kept[4]) == ids(kept[3]) - leaks


def test_encoding(kept):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in kept[4]}
    for r in kept[5]:
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_ids_are_written_before_they_are_decoded(spark):
    """One Python worker per task: the last stage's plan only decodes."""
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (2, "x" * (pieces.GIANT + 1))], "doc_id long, text string")
    out = cp.encode(spark, docs, SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapIn") == 1
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = {r["decoded"]: r for r in out.collect()}
    assert set(rows) == {"one two three", "", "x" * (pieces.GIANT + 1)} and all(r["ids"] == sp.encode(t) for t, r in rows.items())
