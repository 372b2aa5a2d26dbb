import random

import numpy as np

from tidemark.llm import decontaminate as D

from tests.llm.conftest import doc, prose


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = f"new{rng.randint(0, 10 ** 6)}"
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, f"new{rng.randint(0, 10 ** 6)}")
    return out


def brute(docs, items):
    texts, wanted = D.word_hashes([t or "" for _, t in docs]), D.word_hashes([t or "" for _, t in items])
    return sorted(((d, sorted({i for (i, _), x in zip(items, wanted) if len(x) >= D.MIN_WORDS and D.edit_distance(x, h) <= D.allowed(len(x))}))
                   for (d, _), h in zip(docs, texts)), key=str)


def test_edit_distance():
    a = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert [D.edit_distance(a(x), a(y)) for x, y in (("abc", "xxabcxx"), ("abcd", "xabxd"), ("abc", ""), ("kitten", "sitting"))] == [0, 1, 3, 2]


def test_pieces_survive_the_allowed_edits():
    for n in range(5, 120):
        h = np.arange(n, dtype=np.uint64)
        cut = D.pieces_of(h)
        assert len(cut) == D.allowed(n) + 1 and all(size >= 2 and o + size <= n for o, size in cut)
        assert all(a[0] + a[1] <= b[0] for a, b in zip(cut, cut[1:]))


def test_planted_items(spark):
    rng = random.Random(9)
    items = [(i, prose(100 + i, rng.randint(5, 60))) for i in range(25)] + [(98, "too few words"), (99, None), (3, prose(103, 20))]
    docs = []
    for i in range(160):
        text = prose(1000 + i, rng.randint(0, 150)).split()
        if i % 2:
            body = edited(rng, rng.choice(items[:25])[1].upper().split(), rng.choice([0, 0, 0.05, 0.1, 0.15, 0.35]))
            at = rng.randint(0, len(text))
            text[at:at] = body
        docs.append((i, " ".join(text)))
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["item_ids"]) for r in out), key=str) == brute(docs, items)
    assert all(r["contaminated"] == bool(r["item_ids"]) and r["n_items"] == len(r["item_ids"]) for r in out)


def test_recall_of_the_hashing():
    rng = random.Random(5)
    number = lambda: np.uint64(rng.getrandbits(63))
    hits = 0
    for _ in range(150):
        x = [number() for _ in range(rng.randint(10, 70))]
        n = len(x)
        y = list(x)
        for _ in range(int(0.15 * n)):
            k = rng.randrange(len(y))
            y[k:k + 1] = [[number()], [], [number(), y[k]]][rng.randrange(3)]
        z = np.array([number() for _ in range(40)] + y + [number() for _ in range(60)], np.uint64)
        keys = set(D.cgk_keys(np.array([x], np.uint64), n)[0].tolist())
        hits += any(keys & set(D.cgk_keys(z[None, 40 + s:40 + s + n], n)[0].tolist()) for s in D.shifts(D.allowed(n)))
    assert hits >= 147


def test_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(None, prose(4, 80), "x"), (2, "", "x"), (3, prose(6, 40), "x")], "item_id long, text string, hashes string")
    out = D.decontaminate(odd_docs, items).collect()
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(3, prose(6, 40))])
    hit = {d for d, i in want if i}
    assert len(out) == len(want) and {r["doc_id"] for r in out if 3 in r["item_ids"]} == hit == {8}
    assert {r["doc_id"] for r in out if r["contaminated"]} >= hit
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in D.decontaminate(odd_docs, none).collect())
    assert D.decontaminate(no_docs, items).count() == 0
    assert D.decontaminate(spark.createDataFrame([doc(1, prose(6, 40))], odd_docs.schema), items).head()["contaminated"]


def test_long_items_at_the_full_fifth_of_edits(spark):
    rng = random.Random(21)
    items, docs = [], []
    for i, n in enumerate([20, 50, 100, 200, 400] * 8):
        words = [f"w{rng.getrandbits(40)}" for _ in range(n)]
        items.append((i, " ".join(words)))
        body = edited(rng, words, 0.2) if i % 2 else list(words)
        if not i % 2:     # insertions only, at places within the item
            for _ in range(n // 5):
                body.insert(rng.randrange(1, len(body)), f"new{rng.getrandbits(40)}")
        docs.append((i, " ".join([f"x{rng.getrandbits(40)}" for _ in range(70)] + body + [f"x{rng.getrandbits(40)}" for _ in range(90)])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert all(i == [d] for d, i in want)
    assert sorted(((r["doc_id"], r["item_ids"]) for r in D.decontaminate(*frames).collect()), key=str) == want


def test_short_items_match_exact_copies_only(spark):
    items = [(1, "One"), (2, "two  words"), (3, "a b c d"), (4, "  "), (5, "a b c d e")]
    docs = [(1, "this one is"), (2, "TWO words"), (3, "two other words"), (4, "x a b c d y"), (5, "a b x d"), (6, "a b c x d e"), (7, ""), (8, "ones")]
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_ids"] for r in out} == {1: [1], 2: [2], 3: [], 4: [3, 5], 5: [], 6: [5], 7: [], 8: []}


def test_registered_query_goes_through_the_hashing(spark, monkeypatch):
    """Every hit of the given tables is found by keys, as brute force finds it."""
    from tidemark.llm import queries as Q
    made = []
    hashed = D.hashed
    monkeypatch.setattr(D, "hashed", lambda *a: (made.append(hashed(*a)), made[-1])[1])
    out = Q.op2_decontaminate(spark, "/root/testdata/sf0.001").collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert sorted(((r["doc_id"], r["item_ids"]) for r in out), key=str) == brute(docs, items)
    assert made[0].count() >= sum(r["n_items"] for r in out) > 0
