import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle as M

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(leaves, arity):
    """Root, and per leaf the siblings of each level with the own place among them."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i:i + arity] for i in range(0, len(level), arity)]
        for k, i in enumerate(at):
            run = runs[i // arity]
            paths[k].append((i % arity, run[:i % arity] + run[i % arity + 1:]))
        at, level = [i // arity for i in at], [sha(*run) for run in runs]
    return level[0], paths


def fold(digest, path):
    for slot, others in path:
        digest = sha(*others[:slot], digest, *others[slot:])
    return digest


def brute(rows, arity):
    """(doc_id, leaf, subroot, root, proof, root from the tampered leaf) of all rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    below = [tree([leaf(r) for r in groups[x]], arity) for x in langs]
    root, above = tree([s for s, _ in below], arity) if below else (None, [])
    out = []
    for x, (sub, paths), up in zip(langs, below, above, strict=True):
        for r, path in zip(groups[x], paths, strict=True):
            bad = dict(r.asDict())
            if r["n_chars"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                bad["n_chars"] += 1
            proof = "".join(h for _, others in path + up for h in others)
            out.append((r["doc_id"], leaf(r), sub, root, proof, fold(leaf(bad), path + up)))
    return sorted(out, key=str)


def run(df, arity):
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    bad = F.when(touched, M.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]))
    rows = M.manifest(df, FIELDS, "lang", "doc_id", {"bad": bad}, arity)
    start = F.coalesce("bad", "leaf")
    out = rows.select("doc_id", "leaf", "subroot", "root", M.hexed(F.col("proof")).alias("proof_hex"), M.folded_root(start, arity).alias("folded"))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_against_brute_force(spark, arity):
    rng = random.Random(arity)
    langs = ["en"] * 6 + ["de", "é", "z", "", None, "lone"]
    rows = [(i, None if rng.random() < 0.2 else f"s{i % 3}", "lone" if i == 77 else rng.choice(langs[:-1]), None if rng.random() < 0.2 else i, "é" * (i % 4))
            for i in rng.sample(range(1000), 130)] + [(77, "s", "lone", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert run(df, arity) == brute(df.collect(), arity)


def test_odd_documents(odd_docs, no_docs):
    assert run(odd_docs, 2) == brute(odd_docs.collect(), 2)
    assert run(no_docs, 2) == []


def test_tampering_shows_and_only_there(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"),
                                F.lit("t").alias("text"))
    rows = run(df, 2)
    assert {r[0] for r in rows if r[5] != r[3]} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_one_arity_is_refused(odd_docs):
    with pytest.raises(ValueError):
        M.manifest(odd_docs, FIELDS, "lang", "doc_id", arity=1)
