import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import grammar as G


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(G.TOKENIZER)


def brute(tokenizer, rows):
    """(doc_id, start, n, ids) with documents in order; rows of one id by any order."""
    out, at = [], 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, G.END]
        out.append((d, at, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    return out


def files(spark, df, path, **how):
    G.write(df, path, **how)
    rows = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in G.read(spark, path).collect()]
    return sorted(rows, key=lambda r: r[1])


def check_order(got, want):
    """Documents ascend by id (null first), follow each other, and are the wanted ones."""
    assert [r[0] for r in got] == [r[0] for r in want]
    at = 0
    for d, start, n, raw in got:
        assert start == at and len(raw) == 4 * n
        at += n
    assert sorted((str(d), raw) for d, _, _, raw in got) == sorted((str(d), raw) for d, _, _, raw in want)


@pytest.mark.parametrize("block", [G.BLOCK, 500])
def test_odd_documents(spark, odd_docs, no_docs, tokenizer, tmp_path, block):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    check_order(files(spark, odd_docs, f"file://{tmp_path}/odd", block=block), brute(tokenizer, rows))
    assert files(spark, no_docs, f"file://{tmp_path}/none") == []


def test_documents_equal_the_library(spark, tokenizer, tmp_path):
    rng = random.Random(8)
    bits = ["The", "don't", "# ##", "<|endoftext|>", "<|ENDOFTEXT|>", "É́", "́x", "漢字かな", "😀😀", "x" * 200, " ", "　a", "1234", "_", "a-b", "\x1c", "ΑΣ", "İ"]
    rows = [(i, rng.choice([" ", "\n", "\t\x0b"]).join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert files(spark, df, f"file://{tmp_path}/f", block=2000) == brute(tokenizer, rows)


def test_reading_some_documents(spark, tokenizer, tmp_path):
    rows = [(i, f"number {i} of the list " * (i % 30)) for i in range(100)]
    path = f"file://{tmp_path}/f"
    G.write(spark.createDataFrame(rows, "doc_id long, text string"), path, block=60)
    want = [r for r in brute(tokenizer, rows) if r[0] in (3, 29, 59)]
    some = G.read_ids(spark, path, spark.createDataFrame([(3,), (29,), (59,), (3,), (1000,), (None,)], "doc_id long"))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in some.collect()) == want


@pytest.mark.parametrize("case", ["random", "one symbol", "copies", "empty", "single", "texts"])
def test_grammar_round_trip(case):
    rng = np.random.default_rng(3)
    ids = {"random": rng.integers(0, 40, 5000), "one symbol": np.full(4097, 7), "copies": np.tile(rng.integers(0, 49000, 300), 30),
           "empty": np.zeros(0), "single": np.array([5]), "texts": rng.zipf(1.3, 20000) % 3000}[case].astype(np.int64)
    last = rng.random(len(ids)) < 0.01
    if len(ids):
        last[-1] = True
    g = G.Grammar.from_bytes(G.compress(ids, last, 49408).to_bytes())
    assert (G.expand(g, g.symbols) == ids).all() and g.n == len(ids)
    for k in range(len(g.left)):
        assert len(G.expand(g, np.array([g.base + k]))) == g.length[k]
    ends = np.cumsum(g.lengths())
    assert set((np.flatnonzero(last) + 1).tolist()) <= set(ends.tolist())   # no rule spans two documents
    for _ in range(50 if len(ids) else 0):
        lo, hi = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (G.read_range(g, lo, hi) == ids[lo:hi]).all()
    if case in ("one symbol", "copies"):
        assert len(g.to_bytes()) < len(ids)


def test_rules_stand_for_frequent_pairs():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 5, 6, 7, 6, 7], np.int64)
    g = G.compress(ids, np.zeros(len(ids), bool), 10)
    assert list(zip(g.left, g.right, strict=True)) == [(1, 2)] and g.symbols.tolist() == [10, 3, 10, 4, 10, 5, 6, 7, 6, 7]


def test_memory_of_words_only_saves_time(tokenizer):
    e = G.Encoder(G.TOKENIZER, remember=4)
    for texts in (["a b c d e f g"], ["a b c", "", None, "a.b,C 12x"], ["g f e a", "z y x w v"], ["a z", "ÀÉ-ñ! ß", "don't 'tis", "x" * 100 + ".", "≠ a≠b e.́"]):
        got = e(pa.array(texts, pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert got.size.tolist() == [len(w) for w in want] and got.flat.tolist() == [i for w in want for i in w]


def test_every_printable_pair(tokenizer):
    chars = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA0, 0x100), 0x300, 0x301, 0x2028, 0x3000, 0x3C2, 0x130]]
    texts = [f"{a}{b}{a} x{b}{a}y {b}{a}" for a in chars for b in chars]
    got = G.Encoder(G.TOKENIZER)(pa.array(texts, pa.string()))
    ends = np.cumsum(got.size)
    for t, n, z, want in zip(texts, got.size, ends, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.flat[z - n:z].tolist() == want.ids, t


def test_foreign_bytes_are_refused():
    with pytest.raises(ValueError):
        G.Grammar.from_bytes(b"x" * 64)
