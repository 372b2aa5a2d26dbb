import itertools
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import language as L
from tidemark.llm.text import slices, words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    rows = L.identify(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()
    want = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([want[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 6, 4))])
        s = rng.normal(0, 3, (first[-1], 3))
        got = L.viterbi(s, first, switch=2.0)
        for a, b in zip(first[:-1], first[1:]):
            cost = lambda path: sum(s[a + i, k] for i, k in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023,E731
            best = max((cost(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
            assert cost(got[a:b]) == pytest.approx(best)


def test_spans_of_a_mixed_text(spark, model):
    one = lambda lang: duckdb.sql(f"select text from '{SF}/documents.parquet' where lang = '{lang}' and n_chars between 600 and 1500 order by doc_id limit 1").fetchall()[0][0]
    en, de = one("en"), one("de")
    docs = spark.createDataFrame([(1, en + "\n" + de + "\n" + en)], "doc_id long, text string")
    row = L.identify(docs, model, spans=True).head()
    assert row["lang_pred"] == "en" and [s["lang"] for s in row["spans"]] == ["en", "de", "en"]
    raw = (en + "\n" + de + "\n" + en).encode()
    assert abs(row["spans"][1]["start"] - len(en.encode())) < 60 and row["spans"][2]["end"] <= len(raw)


def test_scripts_narrow_candidates():
    texts = ["alpha beta gamma"] * 3 + ["привет мир снова"] * 3 + ["안녕 세상"] * 2
    m = L.train(texts, ["en"] * 3 + ["ru"] * 3 + ["ko"] * 2)
    (b,) = slices(pa.array(["zzz qqq", "незнакомое слово", "한국 사람", "123"], pa.string()))
    assert [L._NAMES[k] if k >= 0 else None for k in L.scripts(b, words(b))] == ["latin", "latin", "cyrillic", "cyrillic", "hangul", "hangul", None]
    (w, labels, weight), = L.label(m, [b])
    best, _ = L.decide(labels, weight, w.first, 3)
    assert [m.langs[k] for k in best[:3]] == ["en", "ru", "ko"]


def test_odd_documents(spark, model, odd_docs, no_docs):
    rows = L.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {1, 2, 3, 10} <= und and 4 not in und and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert L.fit(no_docs) is None and L.identify(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in L.identify(odd_docs, None).collect()} == {"und"}


def test_runs_without_spaces(spark, model):
    rows = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' where n_chars > 300").fetchall()
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    for gap in ("\u00a0", "\u3000", ""):
        df = spark.createDataFrame([(r[0], gap.join(r[1].split())) for r in rows], "doc_id long, text string")
        got = {r["doc_id"]: r["lang_pred"] for r in L.identify(df, model).collect()}
        assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.97


def test_cuts_cover_runs_and_follow_scripts():
    text = "short " + "λόγος" * 9 + "abc" + "世界" * 11 + "!" + "é" * 30 + " don’t"
    (b,) = slices(pa.array([text]))
    w, reach = L._cut(b, L.prefix_hash(L.lowered(b)))
    old = words(b)
    covered = np.zeros(len(b.data), int)
    for s, e in zip(w.start, w.end):
        covered[s:e] += 1
        assert b.data[s:e].tobytes().decode()
    assert (w.end - w.start <= L.GRAM_SPAN).all() and (reach - w.start <= L.GRAM_SPAN).all() and covered.max() == 1
    assert covered.sum() == (old.end - old.start).sum()
    starts = {len(text[:text.index(x)].encode()) for x in ("abc", "世", "é")}
    assert starts <= set(w.start.tolist())
    assert [b.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)][-1] == "don’t"


def test_repeated_ids_reach_the_driver_once(spark, monkeypatch):
    from tidemark.llm import toxicity as T
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i} {k % 7}", "en") for i in ids for k in range(50)] + [(ids[0], None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    seen, plain = [], type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda df: seen.append(plain(df)) or seen[-1])
    texts, _ = L.training_rows(docs)
    assert texts == [f"text {i} 0" for i in ids]
    texts, toxic = T.training_rows(docs, labels)
    assert texts == [""] + [f"text {i} 0" for i in ids[1:]] and toxic.tolist() == [i % 2 for i in ids]
    assert [len(s) for s in seen] == [len(ids)] * 2


def test_hundreds_of_languages():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(60, 300))
    scores[:30, 250] += 40
    scores[30:, 7] += 40
    labels = L.viterbi(scores, np.array([0, 60]))
    assert labels.tolist() == [250] * 30 + [7] * 30
    best, share = L.decide(labels, np.repeat([3, 1], 30), np.array([0, 60]), 300)
    assert best.tolist() == [250] and share[0] == 0.75
