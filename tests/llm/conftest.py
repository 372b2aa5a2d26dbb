"""Shared fixtures: odd documents that every operator has to take."""
import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, kept string, n_lines string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    stems = ["bar", "tol", "min", "que", "sor", "lat", "ven", "dig", "ora", "pel", "ñan", "ßig"]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def doc(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None, 0.5, "x", None, "y")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long_text = prose(1, 30_000)
    shared = prose(2, 120)
    rows = [
        doc(1, None), doc(2, ""), doc(3, "   \n\t "), doc(None, prose(3, 50)), doc(None, None), doc(4, long_text), doc(5, prose(4, 80)),
        doc(5, prose(4, 80)), doc(6, prose(5, 3)), doc(7, prose(5, 3)), doc(8, prose(6, 40) + " " + shared + " " + prose(7, 40)),
        doc(9, prose(8, 30) + " " + shared), doc(10, "!!! 123 ... 456"), doc(11, prose(9, 90), None), doc(12, "\n".join(["a repeated line of enough length"] * 3)),
        (13, "a repeated line of enough length\nown line here that is long too", None, None, None, None, None, None, None),
        doc(14, " A Repeated Line of ENOUGH length\t\nx"), doc(15, "é" * 19 + "\n" + "é" * 20),
    ]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
