import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import infill as I

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, by="word", seed=I.SEED):
    text = text or ""
    units = UNIT.findall(text) if by == "word" else list(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= I.RATE:
        return doc_id, n, "plain", None, None, text, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    form = "spm" if h4 % 100 < I.SPM else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), out, text


def run(df, **how):
    out = I.transform(df, **how)
    return sorted((tuple(r) for r in out.withColumn("back", I.restore(F.col("output"), F.col("form"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()), key=str)


@pytest.mark.parametrize("by", ["word", "char"])
def test_odd_documents(odd_docs, no_docs, by):
    rows = odd_docs.collect()
    assert run(odd_docs, by=by) == sorted((brute(r["doc_id"], r["text"], by) for r in rows), key=str)
    assert run(no_docs) == []


@pytest.mark.parametrize("by", ["word", "char"])
def test_random_texts(spark, by):
    rng = random.Random(6)
    bits = ["a", "é", "漢", "😀", " ", "\n", "\t ", " ", "<", "P>", "<S", "<P>", "word", "\\", "$1", "\x0b", "\x00"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 40, 400])))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = run(df, by=by)
    assert got == sorted((brute(i, t, by) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_index_converts_both_ways():
    text = "aé漢😀b" * 50 + "plain" * 100 + "ñ"
    data = np.frombuffer(text.encode(), np.uint8)
    index = I.CharIndex(data)
    cuts = np.arange(len(text) + 1)
    at = np.array([len(text[:k].encode()) for k in cuts])
    assert (index.bytes(cuts) == at).all() and (index.chars(at) == cuts).all()
    assert len(I.CharIndex(np.frombuffer(b"ascii only", np.uint8)).at_byte) == 0


def test_kept_columns_and_bad_unit(odd_docs):
    out = I.transform(odd_docs, keep=("lang", "kept"))
    assert out.columns == ["doc_id", "lang", "kept", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.count() == odd_docs.count()
    with pytest.raises(ValueError):
        I.transform(odd_docs, by="line")
