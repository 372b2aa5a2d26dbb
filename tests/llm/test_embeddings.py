import numpy as np

from tidemark.llm import embeddings as E


def brute(rows, link=0.93):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows
            if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    near = {i: set() for i, _, _ in rows if i is not None}
    for a, x, la in good:
        for b, y, lb in good:
            if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= link:
                near[a].add(b)
    comp = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            a = todo.pop()
            if a not in comp:
                comp[a] = s
                todo += near[a]
    return near, comp


def vectors(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n // 20):
        center = rng.standard_normal(dim)
        out += [center + 0.12 * c / (n // 20) * 2 * rng.standard_normal(dim) for _ in range(20)]
    return [[float(np.float32(x)) for x in v] for v in out]


def test_recall_and_no_false_links_through_splits(spark):
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(1, 800))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r for r in E.near_duplicates(df, leaf=64).collect()}
    near, comp = brute(rows)
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= len(near[i]) for i in near)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(map(len, near.values()))
    assert np.mean([got[i]["component_id"] == comp[i] for i in near]) > 0.95


def test_odd_vectors(spark):
    base = vectors(2, 40)
    rows = [(10, base[0], 1), (11, base[0], 1), (12, base[0], 2), (13, base[0], None), (None, base[0], 1), (14, None, 1), (15, [], 1),
            (16, [0.0] * 24, 1), (17, [float("nan")] + base[0][1:], 1), (18, [None] + base[0][1:], 1), (19, [float("inf")] + base[0][1:], 1),
            (20, base[0][:5], 1), (21, base[0], 1), (21, base[0], 1), (22, [x * 3 for x in base[0]], 1)]
    schema = "vec_id long, embedding array<float>, label int, rep string, kept int"
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], schema)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df).collect()), key=str)
    near, comp = brute(rows)
    want = sorted(((i, len(near[i]) if i is not None else 0, comp.get(i), i is None or comp[i] == i) for i, _, _ in rows), key=str)
    assert got == want
    assert E.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_pairs_count_once_over_leaves():
    x = np.random.default_rng(0).standard_normal((6, 8))
    x[1] = x[0] + 1e-3
    x[2] = x[0] - 1e-3
    ids, copies = np.arange(6), np.array([1, 2, 1, 1, 1, 1])
    codes = [np.array(c) for c in ([3, 9], [3, 9], [9], [9], [3], [9])]
    first, _ = E.compare_leaf(x[[0, 1, 4]], ids[[0, 1, 4]], copies[[0, 1, 4]], [codes[k] for k in (0, 1, 4)], 3)
    second, low = E.compare_leaf(x[[0, 1, 2, 3, 5]], ids[[0, 1, 2, 3, 5]], copies[[0, 1, 2, 3, 5]], [codes[k] for k in (0, 1, 2, 3, 5)], 9)
    assert first.tolist() == [2, 1, 0] and second.tolist() == [1, 1, 3, 0, 0] and low.tolist() == [0, 0, 0, 3, 5]


def near_copies(rng, n, dim=32, noise=0.18):
    center = rng.standard_normal(dim)
    center /= np.linalg.norm(center)
    x = center + noise * rng.standard_normal((n, dim)) / np.sqrt(dim)
    return x.astype(np.float32)


def links_of(x, link=0.93):
    u = E._unit(x.astype(np.float64))
    return np.concatenate([(u[k:k + 1000] @ u.T >= link).sum(1) - 1 for k in range(0, len(u), 1000)])


def test_groups_of_near_copies_lose_no_link(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([near_copies(rng, n, noise=s) for n, s in ((20, .2), (300, .25), (1200, .27), (1800, .3))] + [rng.standard_normal((3000, 32)).astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(df, leaf=64, part=500).collect()}
    want = links_of(x)
    got = np.array([got[i] for i in range(len(x))])
    assert (got <= want).all()
    for lo, hi in ((0, 20), (20, 320), (320, 1520), (1520, 3320)):
        assert got[lo:hi].sum() >= 0.99 * want[lo:hi].sum() > 0


def test_parts_of_a_leaf_find_the_links_of_the_leaf():
    x = near_copies(np.random.default_rng(3), 900, noise=0.27)
    ids, copies, codes = np.arange(900)[::-1].copy(), np.arange(900) % 3 + 1, [np.array([1, 7] if k % 2 else [7]) for k in range(900)]
    links, low = E.compare_leaf(x, ids, copies, codes, 7)
    at = ids % 3
    total, edges = np.zeros(900, np.int64), []
    for a in range(3):
        for b in range(a, 3):
            r = np.flatnonzero((at == a) | (at == b))
            found, to = E.compare_leaf(x[r], ids[r], copies[r], [codes[k] for k in r], 7, side=None if a == b else at[r] == b)
            total[r] += found
            edges += zip(ids[r], to)
    assert total.tolist() == links.tolist() and links.any()
    label = np.arange(900)
    label = E._merge(label, *np.array(edges).T)
    assert label[ids].tolist() == low.tolist()


def test_vectors_that_differ_by_scale_spread_over_tasks(spark):
    base = np.random.default_rng(4).standard_normal(16)
    rows = [(i, (base * (1 + i)).astype(np.float32).tolist(), 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    packed = E._packed(df.selectExpr("vec_id as rep", "cast(label as long) label", "16 dim", "1L copies", "embedding x"), "<f4")
    sizes = E.tasks_of(E.grow(packed, "<f4", leaf=64), 100).groupBy("code", "one", "two").count().collect()
    assert len({r["code"] for r in sizes}) == 1      # one leaf, not one in every tree
    assert len(sizes) == 15 * 16 // 2 and max(r["count"] for r in sizes) < 300
    got = E.near_duplicates(df, leaf=64, part=100).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(1499, 0)}
