import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import repeats as R


def brute(docs, length):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i:i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((d, len(t), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(t, mark) if not m)).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
                   for r in R.remove_repeats(df, **kw).collect()), key=str)


def test_odd_documents(odd_docs, no_docs):
    assert run(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 200)
    assert R.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("group, broadcast", [(256, 1 << 20), (3, 0)])   # run-length index; hot anchors and joined keys
def test_random_corpora(spark, monkeypatch, group, broadcast):
    monkeypatch.setattr(R, "GROUP", group)
    monkeypatch.setattr(R, "BROADCAST_ROWS", broadcast)
    rng = random.Random(group)
    word = lambda: "".join(rng.choice("abcdeé\0") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    docs = [(i, " ".join(rng.choice([word(), word(), word(), rng.choice(passage)[rng.randint(0, 40):]]) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    docs += [(200, "ab" * 300), (201, "z" * 90), (202, docs[3][1]), (203, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(df, length=60, anchor=16) == brute(docs, 60)


def test_index_marks_all_repeats():
    rng = random.Random(1)
    for _ in range(60):
        base = bytes(rng.choice(b"ab\0c") for _ in range(rng.randint(1, 60)))
        strings = [base[rng.randint(0, len(base) - 1):] + bytes(rng.choice(b"abz") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        length = rng.choice([1, 3, 8, 12, 20])
        count = Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if count[s[i:i + length]] > 1] for s in strings]
        assert [g.tolist() for g in R.mark_batch(strings, length)] == want


def test_repetition_keeps_runs_few():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(400))
    one, many = R.RunIndex([text]), R.RunIndex([text] * 20)
    assert many.n > 19 * one.n and many.runs < 3 * one.runs


def test_long_rows_are_scanned_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(R, "PIECE", 500)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    docs = [(1, text + text[700:1100] + "q"), (2, text[2500:2990])]
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs, 200)
