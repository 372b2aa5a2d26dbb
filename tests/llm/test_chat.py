import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, valid int"


def run(df):
    out = C.format_chats(df).withColumn("back", C.read_back(F.col("formatted"))).withColumn("learned", C.loss_text(F.col("segments")))
    return {r["conv_id"]: r for r in out.collect()}


def test_control_strings_round_trip(spark):
    rng = random.Random(5)
    bits = C.INSTRUCT.controls() + ["\\", "<", ">", "/", "[", "]", "s", "/s>", "INST]", " ", "\n", "é", "<<", "\\<s>", "SYS>>"]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool", " [TEXT] x"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))), "f", 1))
    got = run(spark.createDataFrame(rows, SCHEMA))
    for c in range(150):
        turns = sorted(r[1:4] for r in rows if r[0] == c)
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == [(r, t) for _, r, t in turns]
        assert got[c]["learned"] == "".join(t for _, r, t in turns if r == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]


def test_turn_order(spark):
    chats = {1: "ua", 2: "sua", 3: "uaua", 4: "au", 5: "u", 6: "suua", 7: "su", 8: "usa", 9: "uat"}
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(c, i, names[r], "x", "f", 1) for c, s in chats.items() for i, r in enumerate(s)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert {c for c, r in got.items() if r["valid"]} == {1, 2, 3}
    assert {c: got[c]["first_error"] for c in (4, 5, 6, 7, 8, 9)} == {4: 0, 5: None, 6: 2, 7: None, 8: 1, 9: 2}


def test_odd_rows(spark):
    rows = [(1, 0, None, None, "f", 1), (1, None, "user", "a", "f", 1), (None, 0, "user", "n", "f", 1), (None, 0, "user", "n", "f", 1),
            (2, 1, "assistant", "long " * 50_000, "f", 1), (2, 0, "user", "", "f", 1)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert [(x["role"], x["text"]) for x in got[1]["back"]] == [("user", "a"), ("", "")]
    assert [(x["role"], x["text"]) for x in got[None]["back"]] == [("user", "n")] * 2
    assert got[2]["valid"] and hashlib.sha256(got[2]["learned"].encode()).digest() == hashlib.sha256(b"long " * 50_000).digest()
    assert run(spark.createDataFrame([], SCHEMA)) == {}


def test_no_python_in_the_plan(spark):
    plan = C.format_chats(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1] and "Arrow" not in plan.split("== Physical Plan ==")[1]
