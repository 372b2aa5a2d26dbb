import random

import numpy as np
import pytest
import sentencepiece

from tidemark.llm import pieces as P

from tests.llm.conftest import prose

NASTY = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "𠮷", "the", "ing", "    ", "1", "0", ".", "!!", "==", "----", "\\", "ß"]


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def ids_of(v, text):
    return np.frombuffer(v.encode(P.marked(text)), "<i4")


def chunked(v, text, size):
    m = P.marked(text)
    reach = max(v.longest.values())
    n = -(-len(m) // size)
    chunks = [(m[max(0, k * size - reach):k * size], m[k * size:(k + 1) * size + reach], min(size, len(m) - k * size)) for k in range(n)]
    states = [P._states(v, b, t, z, k, n) for k, (b, t, z) in enumerate(chunks)]
    matrices = [P.transfer(v, t, z, *states[k]) for k, (_, t, z) in enumerate(chunks)]
    matrices[-1] = [[max(row, default=P._NEVER)] for row in matrices[-1]]
    at = P.settle(matrices)
    return b"".join(P.chunk_path(v, t, z, states[k][0][at[k]], (0, "") if k == n - 1 else states[k][1][at[k + 1]]) for k, (_, t, z) in enumerate(chunks))


def test_equals_the_library(vocabulary, library):
    rng = random.Random(1)
    texts = [prose(k, 60) for k in range(40)] + ["".join(rng.choice(NASTY) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for t in texts:
        assert ids_of(vocabulary, t).tolist() == library.encode(t), t


def test_round_trip_with_literal_marks(vocabulary):
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice([*NASTY, "▁", "▁▁"]) for _ in range(rng.randint(0, 30)))
        assert vocabulary.decode(ids_of(vocabulary, t)) == t


def test_chunks_give_the_same_path(vocabulary):
    rng = random.Random(3)
    for k in range(250):
        t = "".join(rng.choice([*NASTY, "▁"]) for _ in range(rng.randint(1, 70))) if k % 2 else "".join(rng.choice("abtheing01=-") for _ in range(rng.randint(1, 120)))
        assert chunked(vocabulary, t, rng.choice([17, 20, 33, 64])) == vocabulary.encode(P.marked(t)), t


def test_matrix_product_is_associative():
    rng = random.Random(4)
    a, b, c = ([[rng.choice([0.0, P._NEVER]) for _ in range(4)] for _ in range(4)] for _ in range(3))
    assert P.combine(P.combine(a, b), c) == P.combine(a, P.combine(b, c))


def test_odd_documents(spark, odd_docs, no_docs, library):
    out = P.decode(P.encode(odd_docs, giant=5000, chunk=700))   # the long text takes the chunked way
    rows = out.select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == odd_docs.count() and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(r["ids"] == library.encode(r["text"] or "") for r in rows)
    assert P.decode(P.encode(no_docs)).count() == 0


def test_decoding_hands_out_the_bytes_of_the_ids_only(spark, no_docs, vocabulary, monkeypatch):
    encoded, sent = P.encode(no_docs), []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value, f=type(spark.sparkContext).broadcast: sent.append(value) or f(self, value))
    assert P.decode(encoded).count() == 0 and sent == [vocabulary.raw]
