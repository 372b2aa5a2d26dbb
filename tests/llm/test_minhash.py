import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import minhash as M
from tidemark.llm.text import slices, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset() if not w else frozenset({tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})


def brute(docs, link=85):
    """Documents are nodes; rows that repeat an id are one node."""
    sets = [(d, shingle_set(t)) for d, t in docs]
    low = {d: d for d, _ in sets if d is not None}
    find = lambda x: x if low[x] == x else find(low[x])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            n = len(x & y)
            if None not in (a, b) and n and 100 * n >= link * (len(x) + len(y) - n):
                p, q = find(a), find(b)
                low[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in M.near_duplicates(df, **kw).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_odd_documents(odd_docs, no_docs):
    assert run(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert M.near_duplicates(no_docs).count() == 0


def test_family_around_the_threshold(spark):
    """Copies of one text with random word changes: similarities on both sides of 0.85."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 400)}" for _ in range(160)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 10 ** 6)}"
        docs.append((1000 - i, " ".join(w)))
    docs += [(i, " ".join(f"u{rng.randint(0, 10 ** 6)}" for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(df) == brute(docs)


def test_estimate_is_close_and_unbiased(spark):
    rng = random.Random(3)
    pairs = []
    for keep in (0.5, 0.7, 0.85, 0.95):
        for _ in range(12):
            a = [f"w{rng.randint(0, 10 ** 9)}" for _ in range(400)]
            b = a[:int(400 * keep)] + [f"w{rng.randint(0, 10 ** 9)}" for _ in range(400 - int(400 * keep))]
            pairs.append((" ".join(a), " ".join(b)))
    (left,), (right,) = (list(slices(pa.array(x, pa.string()), 1 << 40)) for x in zip(*pairs))
    sig = [M.pack(M.minima(*M.shingles(words(b)))[1]).tolist() for b in (left, right)]
    df = spark.createDataFrame(list(zip(*sig)), "sig_a array<bigint>, sig_b array<bigint>")
    got = np.array([r[0] for r in df.select(M.estimate("sig_a", "sig_b")).collect()])
    true = np.array([len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) for a, b in pairs])
    assert abs((got - true).mean()) < 0.02 and np.abs(got - true).max() < 0.2


def test_sets_match_the_definition():
    texts = ["A b  c\td e F", "one two", "", " \n", "x", "É é É é É é", "a b c d e a b c d e a b c d e"]
    (b,) = slices(pa.array(texts, pa.string()))
    assert [len(s) for s in M._sets(b)] == [len(shingle_set(t)) for t in texts]
