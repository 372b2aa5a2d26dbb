import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity as T
from tidemark.llm.text import slices

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return T.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    rows = duckdb.sql(f"select doc_id, text, toxic from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) where toxic is not null").fetchall()
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    column = pa.array([r[1] for r in rows], pa.string())
    score = np.concatenate([T.score_slice(model, b) for b in slices(column)])
    toxic = np.array([r[2] for r in rows]) == 1
    assert toxic.sum() > 50 and (score[toxic] >= 0.5).mean() > 0.85   # about 350 toxic documents to learn from
    assert (score[~toxic] >= 0.5).mean() < 0.01


def test_windows_cover_every_word_and_overlap():
    first = np.array([0, 0, 10, 10 + 64, 10 + 64 + 301])
    idx, doc = T.windows(first, np.arange(first[-1]), -1)
    for d in range(4):
        seen = set(idx[doc == d].ravel().tolist()) - {-1}
        assert seen == set(range(first[d], first[d + 1]))
    assert (doc == 0).sum() == 1 and (doc == 2).sum() == 1 and (doc == 3).sum() == 6
    starts = idx[doc == 3][:, 0]
    assert (np.diff(starts) == T.STRIDE).all() and T.STRIDE < T.WINDOW


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in T._new_weights(rng).items()}
    x = rng.standard_normal((9, T.DIM))
    idx = rng.integers(0, 10, (3, T.WINDOW))

    def loss(q):
        return T._forward(q, T._gates(q, x), idx)[0].sum()

    _, saved = T._forward(p, T._gates(p, x), idx, keep=True)
    grad, _ = T._backward(p, x, saved, np.ones(3))
    for name in ("U", "W", "att", "out", "c"):
        where = tuple(0 for _ in p[name].shape[:-1]) + (1,)
        step = {k: v.copy() for k, v in p.items()}
        step[name][where] += 1e-2
        up = loss(step)
        step[name][where] -= 2e-2
        assert (up - loss(step)) / 2e-2 == pytest.approx(float(np.asarray(grad[name])[where]), rel=0.05, abs=2e-3)


def test_one_toxic_word_in_a_long_text(model):
    clean = duckdb.sql(f"select text from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) where toxic = 0 order by doc_id limit 8").fetchall()
    text = " ".join(t for t, in clean)
    score = lambda t: float(T.score_slice(model, next(slices(pa.array([t], pa.string()), 1 << 40)))[0])
    assert score(text) < 0.5 < score(text + " " + text + " idiot moron " + text)


def test_odd_documents(spark, model, odd_docs, no_docs):
    rows = T.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert T.score(no_docs, model).count() == 0
    none = T.fit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in T.score(odd_docs, none).collect()} == {0.0}


def test_training_rows_exclude_held_out_and_repeats(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "extra") for i in range(60)] + [(3, "text 3", "extra")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(3, 0, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    texts, toxic = T.training_rows(docs, labels)
    want = sorted(f"text {i}" for i in range(60) if zlib.crc32(str(i).encode()) % 5)
    assert sorted(texts) == want and toxic[texts.index("text 3")] == 1


def test_every_byte_of_a_run_without_spaces_is_an_input():
    for text in ("x" * 3 + "".join(chr(97 + (k * k + k // 7) % 26) for k in range(200)), "".join(chr(0x4E00 + 37 * k) for k in range(90)), "a€ñ😀" * 40):
        (b,) = slices(pa.array([text]))
        v = T.vocabulary(b)
        raw = text.encode()
        c = T.prefix_hash(T.lowered(b))
        at = np.arange(len(raw) - T.GRAM + 1)
        want = set((T.span_hash(c, at, at + T.GRAM) % np.uint64(T.GRAM_BUCKETS)).astype(np.int64).tolist())
        assert set(v.grams[:, len(T.PREFIXES):].ravel().tolist()) - {-1} == want


def test_joined_words_are_judged_as_well(spark, model):
    rows = duckdb.sql(f"select doc_id, text, toxic from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) where toxic is not null").fetchall()
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    toxic = np.array([r[2] for r in rows]) == 1
    recall, wrong = {}, {}
    for gap in (" ", "\u00a0", "\u3000", "_", ","):
        score = np.concatenate([T.score_slice(model, b) for b in slices(pa.array([gap.join(r[1].split()) for r in rows], pa.string()))])
        recall[gap], wrong[gap] = (score[toxic] >= 0.5).mean(), (score[~toxic] >= 0.5).mean()
    assert recall["\u00a0"] == recall["\u3000"] == recall[" "], (recall, wrong)
    assert min(recall.values()) > 0.6 and max(wrong.values()) < 0.02, (recall, wrong)
