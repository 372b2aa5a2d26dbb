import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import lines as L


def brute(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                held[key(x)].add(d)
    out = []
    for d, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if d is None or not (len(held[key(x)]) >= 3 and d < max(held[key(x)]))]
        out.append((d, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in L.dedup_lines(df).collect()), key=str)


def test_odd_documents(odd_docs, no_docs):
    assert run(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert L.dedup_lines(no_docs).count() == 0


def test_random_documents(spark):
    rng = random.Random(4)
    pool = [f"common line number {k} of the pool" for k in range(12)] + ["short", "", "  Common LINE number 3 of the pool\t"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {i} {j} that nobody shares" for j in range(rng.randint(0, 8)))) for i in range(120)]
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    hi, lo = rng.integers(-1 << 62, 1 << 62, (2, 5000))
    f = L.CuckooFilter.of(hi[:4000], lo[:4000])
    f = L.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(hi[:4000], lo[:4000]).all() and f.contains(hi[4000:], lo[4000:]).mean() < 0.01
    f.remove(hi[:2000], lo[:2000])
    assert f.contains(hi[2000:4000], lo[2000:4000]).all() and f.contains(hi[:2000], lo[:2000]).mean() < 0.01
    tiny = L.CuckooFilter.sized(16)
    assert not tiny.insert(hi[:200], lo[:200])


def test_store_is_reversible(spark, tmp_path):
    line, rest = "a line that several documents hold", "own text of document {} only"
    docs = lambda ids: spark.createDataFrame([(i, line + "\n" + rest.format(i)) for i in ids], "doc_id long, text string")
    dropped = lambda s, ids: {r["doc_id"] for r in s.apply(docs(ids)).collect() if r["n_dropped"]}
    s = L.LineStore(spark, f"file://{tmp_path}/store", shards=4)
    s.insert(docs([1, 2]))
    assert dropped(s, [1, 2]) == set()
    s.insert(docs([5, 3]))
    assert dropped(s, [1, 2, 3, 5]) == {1, 2, 3}
    before = sorted(map(tuple, s._read("counts").collect()))
    s.insert(docs([9]))
    assert dropped(s, [1, 5, 9]) == {1, 5}
    s.delete(docs([9]))
    assert sorted(map(tuple, s._read("counts").collect())) == before
    s.delete(docs([5, 1]))
    assert dropped(s, [2, 3]) == set()
    s.delete(docs([2, 3]))
    assert s._read("refs").count() == 0


class Killed(Exception):
    pass


def test_store_survives_reopening_and_lost_runs(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    pool = [f"shared line number {k} of the pool" for k in range(8)]
    text = {i: "\n".join([*rng.sample(pool, 3), f"only document {i} holds this line"]) for i in range(30)}
    docs = lambda ids: spark.createDataFrame([(i, text[i]) for i in ids], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    store = lambda: L.LineStore(spark, path, shards=4)
    alive: set[int] = set()

    def check(s):
        got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in s.apply(docs(sorted(alive))).collect()), key=str)
        assert got == brute([(i, text[i]) for i in sorted(alive)])

    assert store().version == 0 and store().apply(docs([1])).first()["n_dropped"] == 0
    for version, (what, ids) in enumerate([("insert", range(0, 12)), ("insert", range(8, 20)), ("delete", [19, 11, 3]), ("insert", range(20, 30)), ("delete", range(15, 30)), ("insert", [29])], 1):
        with monkeypatch.context() as m:   # the first try dies before its version is complete
            def dies(*_):
                raise Killed
            m.setattr(L.LineStore, "_finish", dies)
            with pytest.raises(Killed):
                getattr(store(), what)(docs(ids))
        assert store().version == version - 1
        s = store()
        getattr(s, what)(docs(ids))
        alive = alive | set(ids) if what == "insert" else alive - set(ids)
        assert s.version == store().version == version
        check(store())
        want = sorted(map(tuple, L.count_references(L.references(docs(sorted(alive)))).collect()))
        assert sorted(map(tuple, store()._read("counts").collect())) == want
    with pytest.raises(ValueError):
        L.LineStore(spark, path, min_docs=4)


def test_shards_grow_with_the_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 20)
    docs = lambda lo, hi: spark.createDataFrame([(i * 3 + j, f"line number {i} that three documents hold") for i in range(lo, hi) for j in range(3)], "doc_id long, text string")
    s = L.LineStore(spark, f"file://{tmp_path}/store", shards=2)
    s.insert(docs(0, 30))
    s.insert(docs(30, 130))
    assert s.shards == 7 and L.LineStore(spark, s.path).shards == 7
    assert sum(r["n_dropped"] for r in s.apply(docs(0, 130)).collect()) == 260


@pytest.mark.parametrize("line, counts", [("x" * 19, False), ("x" * 20, True), ("é" * 20, True), ("é" * 19, False), ("  " + "y" * 19 + " ", False)])
def test_key_length_is_in_code_points(line, counts):
    assert (L.line_key(line) is not None) is counts
