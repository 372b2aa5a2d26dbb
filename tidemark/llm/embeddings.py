"""Embedding near-duplicates by a forest of random-projection trees (op 4).

Vectors are compared only when labels (and lengths) are equal; pairs with
cosine >= ``LINK`` in double precision are linked. Equal vectors are one class
with a number of copies, so copies are never expanded.

``TREES`` trees split each label's vectors again and again along random
directions at the median. Vectors within half the chord of the link angle of a
cut, and at least the share ``SPILL`` on each side, go to both children. A node
is not split further, but compared exactly, when the share ``DENSE`` of its
pairs are links (cuts would go through a group of near copies) or when a child
would keep more than ``MAX_CHILD`` of it (the cut would save no work); if that
is a tree's root, the other trees are not grown. A round fits up to ``LEVELS`` levels of every open node from a
sample of about ``FIT_ROWS`` of its vectors (one bounded group per node) and
routes all rows; nodes above ``LEAF`` rows stay open for the next round, so
depth follows the input while no group or broadcast does. Directions come from
a seed. Within a leaf all pairs are compared as matrix blocks; a leaf above
``PART`` rows is dealt into salted parts, and every two parts are a task of
their own, so no task holds more than two parts however large the leaf is.

A pair that meets in several leaves counts in the first of them (each row
carries the codes of its leaves), so tasks emit one count per vector and one
spanning forest of links, never the pairs themselves. Counts are summed and the
forests united by connected components.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or ``vec_id``, link with nothing and are
kept; rows that repeat a ``vec_id`` and vector count once; further columns are
ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import saved
from tidemark.operators.components import connected_components

LINK = 0.93
TREES = 8
SPILL = 0.05
LEAF = 512
LEVELS = 6
FIT_ROWS = 4096
MIN_FIT = 64        # sample rows that a split needs
MAX_DEPTH = 48
DENSE = 1 / 16      # share of linked pairs at which a node is compared whole
MAX_CHILD = 0.7     # 2 * 0.7 ** 2 is about 1: two children cost as much as the node
PAIR_ROWS = 256     # sample rows that the share is estimated from
PART = 4096         # rows of a task's part of a leaf
BLOCK = 512
SEED = 93


def _direction(tree: int, depth: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree, depth]).standard_normal(dim)


def _matrix(column: pd.Series, dim: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _dense(x: np.ndarray, link: float) -> bool:
    """Whether the share ``DENSE`` of the pairs of a sample are links."""
    x = x[:: -(-len(x) // PAIR_ROWS)]
    return bool((x @ x.T >= link).sum() - len(x) >= DENSE * len(x) * (len(x) - 1))


def fit_node(x: np.ndarray, size: int, tree: int, depth: int, leaf: int, link: float = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of a subtree of at most ``LEVELS`` levels over unit vectors ``x``,
    a sample of a node with ``size`` rows. Heap order; (low, high) of a cut, NaN
    at leaves; ``state`` is 1 where a leaf is final, 0 where it must go on."""
    cuts = np.full((1 << (LEVELS + 1), 2), np.nan)
    final = np.zeros(1 << (LEVELS + 1), np.int8)
    weight = size / max(len(x), 1)
    proj = np.stack([x @ _direction(tree, depth + k, x.shape[1]) for k in range(LEVELS)]) if len(x) else None
    margin = np.sqrt(max(0.0, 2 - 2 * link)) / 2
    todo = [(1, np.arange(len(x)))]
    while todo:
        h, rows = todo.pop()
        level = h.bit_length() - 1
        if len(rows) * weight <= leaf or depth + level >= MAX_DEPTH:
            final[h] = 1
            continue
        if level == LEVELS or len(rows) < MIN_FIT:
            continue
        if _dense(x[rows], link):
            final[h] = 1
            continue
        p = proj[level, rows]
        low, middle, high = np.quantile(p, [0.5 - SPILL, 0.5, 0.5 + SPILL])
        low, high = min(low, middle - margin), max(high, middle + margin)
        left, right = rows[p <= high], rows[p >= low]
        if max(len(left), len(right)) > MAX_CHILD * len(rows):
            final[h] = 1
            continue
        cuts[h] = low, high
        todo += [(2 * h, left), (2 * h + 1, right)]
    return cuts, final


def route(x: np.ndarray, node: int, tree: int, cuts: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` (unit vectors) at the leaves of a subtree: row index, node, final."""
    depth = node.bit_length() - 1
    at, heap = np.arange(len(x)), np.ones(len(x), np.int64)
    out = []
    for level in range(LEVELS + 1):
        low = cuts[heap, 0]
        stop = np.isnan(low)
        out.append((at[stop], (np.int64(node) << level) | (heap[stop] - (1 << level)), final[heap[stop]] == 1))
        at, heap, low = at[~stop], heap[~stop], low[~stop]
        if not len(at):
            break
        p = x[at] @ _direction(tree, depth + level, x.shape[1])
        left, right = p <= cuts[heap, 1], p >= low
        at, heap = np.concatenate([at[left], at[right]]), np.concatenate([2 * heap[left], 2 * heap[right] + 1])
    return tuple(np.concatenate(a) for a in zip(*out, strict=True))


def _valid(x: Column) -> Column:
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & ok & F.exists(x, lambda v: v != 0), F.lit(False))


def _packed(rows: DataFrame, dtype: str) -> DataFrame:
    """(rep, label, dim, copies, v) with the vector as raw bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(dtype).tobytes()
            size = np.dtype(dtype).itemsize
            ends = np.concatenate([[0], np.cumsum(np.asarray(x.value_lengths()))]).astype(np.int64) * size
            v = pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "label", "dim", "copies")), v],
                                             ["rep", "label", "dim", "copies", "v"])

    return rows.select("rep", "label", "dim", "copies", "x").mapInArrow(run, "rep long, label long, dim int, copies long, v binary")


def grow(vectors: DataFrame, dtype: str, trees: int = TREES, leaf: int = LEAF, link: float = LINK) -> DataFrame:
    """(rep, label, dim, copies, v, code): every vector in every leaf that it
    falls into. ``code`` names tree and leaf; smaller codes come first."""
    key = ["label", "dim", "tree", "node"]
    group = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    small = vectors.join(group.where(F.col("size") <= leaf).select("label", "dim"), ["label", "dim"], "left_semi")
    done = [small.withColumn("tree", F.lit(0)).withColumn("node", F.lit(1).cast("long"))]
    rows = (vectors.join(group.where(F.col("size") > leaf).select("label", "dim"), ["label", "dim"], "left_semi")
            .withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)]))).withColumn("node", F.lit(1).cast("long")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        x = _unit(_matrix(pdf["v"], head["dim"], dtype))
        cuts, final = fit_node(x, int(head["size"]), int(head["tree"]), int(head["node"]).bit_length() - 1, leaf, link)
        return pd.DataFrame({**{k: [head[k]] for k in key}, "cuts": [cuts.tobytes()], "final": [final.tobytes()], "whole": [bool(final[1])]})

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (_, dim, tree, node), part in pdf.groupby(key, sort=False):
                cuts = np.frombuffer(part["cuts"].iloc[0]).reshape(-1, 2)
                final = np.frombuffer(part["final"].iloc[0], np.int8)
                at, new, stop = route(_unit(_matrix(part["v"], dim, dtype)), int(node), int(tree), cuts, final)
                yield part[["rep", "label", "dim", "copies", "v", "tree"]].iloc[at].assign(node=new, stop=stop)

    shape = "rep long, label long, dim int, copies long, v binary, tree int, node long"
    k = 0
    while not rows.isEmpty():
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
        chance = F.pmod(F.xxhash64("rep", "tree", F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        sample = rows.join(sizes, key).where(chance < F.lit(float(FIT_ROWS)) / F.col("size"))
        fitted = saved(sample.groupBy(*key).applyInPandas(fit, "label long, dim int, tree int, node long, cuts binary, final binary, whole boolean"), f"cuts-{k}")
        if k == 0:   # a tree that is one leaf compares everything
            only = fitted.where("whole").groupBy("label", "dim").agg(F.min("tree").alias("only"))
            fitted = fitted.join(only, ["label", "dim"], "left").where(F.coalesce("only", "tree") == F.col("tree")).drop("only")
        routed = saved(rows.join(fitted, key).mapInPandas(send, f"{shape}, stop boolean"), f"routed-{k}")
        done.append(routed.where("stop").drop("stop"))
        rows = routed.where("not stop").drop("stop")
        k += 1
    out = done[0].select("rep", "label", "dim", "copies", "v", "tree", "node")
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("rep", "label", "dim", "copies", "v", (F.shiftleft(F.col("tree").cast("long"), 50) + F.col("node")).alias("code"))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (index of the smallest row known to be reached) after the rows ``a`` were linked with ``b``."""
    while len(a):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        x, y = label[a], label[b]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return label


def compare_leaf(x: np.ndarray, ids: np.ndarray, copies: np.ndarray, codes: list[np.ndarray], code: int,
                 link: float = LINK, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a leaf that no earlier leaf holds: how many vectors each row is
    linked with, and for each row the smallest id it reaches here. With ``side``
    only rows of different sides are compared."""
    u = _unit(x)
    n = len(ids)
    earlier = [c[c < code] for c in codes]
    who = np.repeat(np.arange(n), [len(e) for e in earlier])
    names, where, many = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    who, where = who[many[where] > 1], where[many[where] > 1]   # a leaf of one of the rows is shared by no pair
    names, where = np.unique(where, return_inverse=True)
    chunk = max(1, min(len(names), (1 << 23) // n))      # names of one matrix
    links = np.zeros(n, np.int64)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    label = np.arange(n)                # by rank
    order = np.array(sorted(range(n), key=lambda r: earlier[r].tobytes()))   # rows of equal earlier leaves together
    rows, cols = (order, np.arange(n)) if side is None else (order[~side[order]], np.flatnonzero(side))
    for lo in range(0, len(rows), BLOCK):
        part = rows[lo:lo + BLOCK]
        inside = np.zeros(n, bool)
        inside[part] = True
        shared = np.bincount(where[inside[who]], minlength=len(names)) == len(part)
        done = np.zeros(n, bool)
        done[who[shared[where]]] = True     # met all rows of the block in one earlier leaf
        rest = cols[~done[cols]]
        if not len(rest):
            continue
        hit = (u[part] @ u[rest].T >= link) & (ids[part, None] != ids[rest])
        for first in range(0, len(names) if hit.any() else 0, chunk):
            now = (where >= first) & (where < first + chunk)
            met = np.zeros((n, chunk), np.float32)
            met[who[now], where[now] - first] = 1
            hit &= met[part] @ met[rest].T == 0
        links[part] += hit @ copies[rest]
        if side is not None:
            links[rest] += hit.T @ copies[part]
        i, j = np.nonzero(hit)
        label = _merge(label, rank[part[i]], rank[rest[j]])
    return links, ids[by_id][label[rank]]


def tasks_of(placed: DataFrame, part: int = PART) -> DataFrame:
    """The rows of the leaves in each task (label, dim, code, one, two) that
    compares them: parts ``one`` and ``two`` of a leaf, ``at`` is the row's part."""
    key = ["label", "dim", "code"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias("parts"))
    return (placed.join(parts, key).withColumn("at", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("one", F.least("at", "other")).withColumn("two", F.greatest("at", "other")).drop("other", "parts"))


def near_duplicates(embeddings: DataFrame, link: float = LINK, trees: int = TREES, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings``
    (vec_id, embedding, label)."""
    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("x"))
    usable = _valid(F.col("x")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = saved(rows.withColumn("ok", usable).withColumn("h1", F.xxhash64("label", "x")).withColumn("h2", F.xxhash64(F.lit(SEED), "x", "label")), "vectors")
    real = rows.where("ok")
    once = real.groupBy("vec_id", "h1", "h2").agg(F.first("label").alias("label"), F.first("x").alias("x"))
    classes = once.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("x").alias("x"))
    classes = saved(classes.withColumn("dim", F.size("x")), "classes")
    placed = saved(grow(saved(_packed(classes, dtype), "packed"), dtype, trees, leaf, link), "leaves")
    codes = placed.groupBy("rep", "label", "dim").agg(F.array_sort(F.collect_list("code")).alias("codes"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["rep"].to_numpy()
        head = pdf.iloc[0]
        side = None if head["one"] == head["two"] else pdf["at"].to_numpy() == head["two"]
        found, low = compare_leaf(_matrix(pdf["v"], head["dim"], dtype), ids, pdf["copies"].to_numpy(),
                                  [np.asarray(c) for c in pdf["codes"]], int(head["code"]), link, side)
        out = pd.DataFrame({"rep": ids, "found": found, "low": low})
        return out[out["found"] > 0]

    leaves = tasks_of(placed, part).join(codes, ["rep", "label", "dim"]).groupBy("label", "dim", "code", "one", "two")
    links = saved(leaves.applyInPandas(compare, "rep long, found long, low long"), "links")
    groups = connected_components(links.where("rep <> low"), "rep", "low").select(F.col("vertex").alias("rep"), F.col("label").alias("to"))
    facts = (classes.select("h1", "h2", "rep", "copies").join(links.groupBy("rep").agg(F.sum("found").alias("found")), "rep", "left")
             .join(groups, "rep", "left")
             .select("h1", "h2", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("to", "rep").alias("component_id")))
    linked = real.select("vec_id", "h1", "h2").join(facts, ["h1", "h2"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
