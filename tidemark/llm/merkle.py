"""Merkle manifest of a dataset (op 11).

Every row is a leaf: the SHA-256 of its fields, each written as ``-`` (null) or
byte count, ``:``, value. The leaves of a group, in the given order, are the
lowest level of the group's tree; while a level has several nodes, runs of
``arity`` consecutive ones become their hash (the last run may be shorter, down
to one). The groups' roots, ordered by group (null first, then bytewise), make
the top tree in the same way. A row's proof is what a reader needs to recompute
the root from its leaf: the other nodes of its run on each level, left to right,
upwards through its group's tree and the top tree.

Levels are built by sibling-shift self-joins. A node is (tree, idx, n) with n the
nodes of its level; its siblings have computed indices (``idx XOR 1`` for two,
else the other slots of the run by offset), found by an equijoin of the level
with itself; rows of slot zero then emit the parents. Proofs run the other way: a
node's path is its siblings before its parent's path, one equijoin per level.

Indices come from one range partitioning: a row's place in its sorted partition
less that of its group's first row there, plus the group's rows in earlier
partitions; that last table has at most (partitions + groups) rows. So no group,
however large, meets in one task: joins are on (tree, idx), which is unique.
Levels are written to the shared folder, and each has half the rows of the one
below (digests are 32 bytes), so all of them take about twice the lowest. The
driver sees four numbers: rows of the largest group, groups, and nothing else
but the root.

Defined results: null fields are ``-`` and differ from empty ones; rows with null
order keys come first; rows that repeat an order key are leaves of their own,
ordered by their digest; an empty table gives no rows; a group of one row has that
leaf as its root; columns not named take no part.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import saved

ARITY = 2
WIDTH = 32   # bytes of a digest


def sha(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hexed(digests: Column) -> Column:
    """Digests, one behind the other, as lowercase hex."""
    return F.lower(F.hex(digests))


def leaf(fields: Sequence[Column]) -> Column:
    """Hex digest of a row's fields."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return sha(*parts)


def _numbered(rows: DataFrame, group: str, order: list[str], carry: list[str]) -> tuple[DataFrame, int, int]:
    """(tree, idx, n, carry) of every row, groups, and rows of the largest one.
    ``order`` is total, and ``group`` a string that is never null."""
    keys = [group, *order]
    here = F.spark_partition_id()
    placed = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        group, *carry, here.alias("_part"), (F.monotonically_increasing_id() - F.shiftleft(here.cast("long"), 33)).alias("_at")), "merkle-order")
    by_group = Window.partitionBy(group).orderBy("_part")
    runs = placed.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")).withColumns({
        "_before": F.coalesce(F.sum("_rows").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("_rows").over(Window.partitionBy(group))})
    runs = saved(runs, "merkle-runs")
    # a group's number: groups that start in earlier partitions, and earlier ones here
    begin = runs.where("_before = 0")
    per_part = begin.groupBy("_part").agg(F.count(F.lit(1)).alias("_groups"))   # one row per partition
    earlier = per_part.select("_part", F.coalesce(F.sum("_groups").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    trees = begin.join(earlier, "_part").select(group, (F.col("_off") + F.row_number().over(Window.partitionBy("_part").orderBy(group)) - 1).alias("tree"))
    known = runs.join(trees, group).select("_part", group, "tree", "n", (F.col("_before") - F.col("_first")).alias("_shift"))
    out = placed.join(known, ["_part", group]).select("tree", (F.col("_shift") + F.col("_at")).alias("idx"), "n", *carry)
    sizes = begin.agg(F.count(F.lit(1)), F.max("n")).first()
    return out, sizes[0], sizes[1] or 0


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``others``: the digests of the other nodes of the run, left to right."""
    other = nodes.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("digest").alias("_d"))
    none = F.lit("").cast("binary")
    if arity == 2:
        shift = F.col("idx").bitwiseXOR(F.lit(1))
        joined = nodes.withColumn("_sib", shift).join(other, (F.col("tree") == F.col("_t")) & (F.col("_sib") == F.col("_i")), "left")
        return joined.withColumn("others", F.coalesce("_d", none)).drop("_sib", "_t", "_i", "_d")
    out, found = nodes, []
    for offset in range(1, arity):
        slot = (F.col("idx") % arity + offset) % arity
        sib = other.select(F.col("_t").alias(f"_t{offset}"), F.col("_i").alias(f"_i{offset}"), F.col("_d").alias(f"_d{offset}"))
        out = out.withColumn(f"_s{offset}", F.col("idx") - F.col("idx") % arity + slot)
        out = out.join(sib, (F.col("tree") == F.col(f"_t{offset}")) & (F.col(f"_s{offset}") == F.col(f"_i{offset}")), "left")
        found.append(F.struct(F.col(f"_s{offset}").alias("at"), F.col(f"_d{offset}").alias("digest")))
    run = F.array_sort(F.filter(F.array(*found), lambda x: x["digest"].isNotNull()))
    out = out.withColumn("others", F.aggregate(run, none, lambda acc, x: F.concat(acc, x["digest"])))
    return out.drop(*(f"_{c}{k}" for c in "tisd" for k in range(1, arity)))


def _levels(leaves: DataFrame, most: int, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Every level with its siblings, lowest first (trees that have ended are
    gone from the higher ones), and the roots (tree, height, digest)."""
    def climb(level: DataFrame) -> DataFrame:
        """Rows of slot zero emit their parents."""
        return level.where((F.col("idx") % arity == 0) & (F.col("n") > 1)).select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            F.unhex(sha(hexed(F.col("digest")), hexed(F.col("others")))).alias("digest"))

    # the lowest level is read twice by its self-join: it is a written table
    levels = [saved(_with_siblings(leaves, arity), f"merkle-{name}-0")]
    roots = levels[0].where("n = 1").select("tree", F.lit(0).alias("height"), "digest")
    while most > 1:
        above = climb(levels[-1])
        most = -(-most // arity)
        roots = roots.unionByName(above.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
        if most > 1:
            levels.append(saved(_with_siblings(above.where("n > 1"), arity), f"merkle-{name}-{len(levels)}"))
    return levels, saved(roots, f"merkle-{name}-roots")


def _paths(levels: list[DataFrame], tops: DataFrame, carry: list[str], arity: int, name: str) -> DataFrame:
    """The lowest level with each node's path: its siblings, its parent's
    siblings and so on, then its tree's ``path`` in ``tops`` (tree, height, path,
    carry), of which ``height`` and ``carry`` come along."""
    known = ["height", *carry, "path"]
    down = None
    for k in range(len(levels) - 1, -1, -1):
        ended = F.col("height") <= 1 if k == 0 else F.col("height") == k + 1
        up = tops.where(ended).select("tree", F.lit(0).cast("long").alias("_up"), *known)
        if down is not None:
            up = up.unionByName(down.select("tree", F.col("idx").alias("_up"), *known))
        level = levels[k] if k == 0 else levels[k].select("tree", "idx", "others")
        level = level.withColumn("_up", F.expr(f"idx div {arity}"))
        rest = [c for c in level.columns if c not in ("_up", "others")] if k == 0 else ["tree", "idx"]
        down = level.join(up, ["tree", "_up"]).select(*rest, "height", *carry, F.concat("others", "path").alias("path"))
        if k and k % 4 == 0:
            down = saved(down, f"merkle-{name}-paths")
    return down


def fold(digest: Column, proof: Column, at: Column, steps: tuple[Column, Column, Column], arity: int = ARITY) -> Column:
    """struct<digest, at>: the node that a digest (hex) and the digests of
    ``proof`` from byte ``at`` on lead to, ``steps`` = (levels, idx, n) further up."""
    height, idx, n = steps

    def step(acc: Column, _: Column) -> Column:
        slot = acc["idx"] % arity
        run = F.least(F.lit(arity).cast("long"), acc["n"] - acc["idx"] + slot)
        left, right = slot * WIDTH, (run - 1 - slot) * WIDTH
        cut = lambda begin, size: hexed(F.substring(proof, (begin + 1).cast("int"), size.cast("int")))
        return F.struct(sha(cut(acc["at"], left), acc["digest"], cut(acc["at"] + left, right)).alias("digest"),
                        (acc["at"] + left + right).alias("at"), F.floor(acc["idx"] / arity).cast("long").alias("idx"),
                        F.ceil(acc["n"] / arity).cast("long").alias("n"))

    start = F.struct(digest.alias("digest"), at.cast("long").alias("at"), idx.cast("long").alias("idx"), n.cast("long").alias("n"))
    levels = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, start, step)


def manifest(rows: DataFrame, fields: Sequence[str], group: str, order: str, carry: Mapping[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """One row per row of ``rows``: ``order``, leaf, subroot, root (hex), proof
    (digests, 32 bytes each), tree (its group's place), trees, idx (its place in
    the group), n (rows of the group), height and top_height (levels above the
    leaves and above the subroots), and the columns of ``carry``, computed on ``rows``."""
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    carry = dict(carry or {})
    name = lambda c: F.col(f"`{c}`")
    leaves = saved(rows.select(
        F.coalesce(F.concat(F.lit("="), name(group).cast("string")), F.lit("")).alias("_group"), name(order).alias("_order"),
        F.unhex(leaf([name(f) for f in fields])).alias("digest"), F.monotonically_increasing_id().alias("_row"),
        *(c.alias(f"_c_{k}") for k, c in carry.items())), "merkle-leaves")
    own = [f"_c_{k}" for k in carry]
    # equal rows may spread over partitions: the last key tells them apart
    numbered, trees, most = _numbered(leaves, "_group", ["_order", "digest", "_row"], ["_order", "digest", *own])
    levels, roots = _levels(saved(numbered, "merkle-numbered"), most, arity, "rows")
    top = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest")
    top_levels, top_root = _levels(top, trees, arity, "top")
    root = top_root.first()   # one row, or none for an empty table
    over = top_root.select("tree", "height", F.lit("").cast("binary").alias("path"))
    subroots = _paths(top_levels, over, [], arity, "top").select(F.col("idx").alias("tree"), F.hex("digest").alias("_hex"), "path")
    tops = roots.join(subroots, "tree").select("tree", "height", F.lower("_hex").alias("subroot"), "path")
    out = _paths(levels, saved(tops, "merkle-tops"), ["subroot"], arity, "rows")
    return out.select(
        F.col("_order").alias(order), hexed(F.col("digest")).alias("leaf"), "subroot",
        F.lit(root["digest"].hex() if root else None).cast("string").alias("root"), F.col("path").alias("proof"),
        "tree", F.lit(trees).cast("long").alias("trees"), F.lit(height_of(trees, arity)).alias("top_height"), "idx", "n", "height", *(F.col(f"_c_{k}").alias(k) for k in carry))


def height_of(n: int, arity: int = ARITY) -> int:
    """Levels above the lowest one of a tree with n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


def folded_root(leaf_digest: Column, arity: int = ARITY) -> Column:
    """The root that a leaf (hex) and the proof of its manifest row lead to."""
    of = lambda *names: tuple(F.col(c) for c in names)
    sub = fold(leaf_digest, F.col("proof"), F.lit(0), of("height", "idx", "n"), arity)
    return fold(sub["digest"], F.col("proof"), sub["at"], of("top_height", "tree", "trees"), arity)["digest"]
