"""Chat formatting in DataFrame expressions (op 6).

A template says declaratively how each role is marked and which segments count
for the loss; a finite-state machine over the roles validates the turn order.
Per conversation the operator emits the segments (text, loss flag), the
formatted text they make up, whether the order is valid and, if not, the first
turn that breaks it. Control strings inside texts are broken by a backslash
after their first character and backslashes are doubled, so the output can be
read back without loss (:func:`read_back`).

Everything is built-in expressions over one array per conversation: a
conversation is one record of the output, so its turns must meet in one row;
different conversations never do.

Defined results: null texts and roles read as empty; turns are ordered by turn,
role and text (null turns first), repeated rows count; rows with a null
``conv_id`` are one conversation; roles unknown to the template are written
with their name and break the order; further columns are ignored.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "[ROLE] ", " [TEXT] ", " [/ROLE]"


@dataclass(frozen=True)
class Template:
    """``marks``: role -> (before, after); ``loss``: roles whose text is learned;
    ``moves``: (state, role) -> state; ``final``: states in which a conversation may end."""
    marks: tuple[tuple[str, str, str], ...]
    loss: tuple[str, ...]
    moves: tuple[tuple[str, str, str], ...]
    final: tuple[str, ...]

    def controls(self) -> list[str]:
        """Strings that must not occur inside a text."""
        parts = [p.strip() for _, a, b in self.marks for p in (a, b)] + [p.strip() for p in OTHER]
        return list(dict.fromkeys(p for p in parts if p))


INSTRUCT = Template(
    marks=(("system", "<<SYS>>\n", "\n<</SYS>>\n"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s> ", " </s>")),
    loss=("assistant",),
    moves=(("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
           ("user", "assistant", "assistant"), ("assistant", "user", "user")),
    final=("assistant",),
)


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls():
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, t: Template) -> Column:
    """Before, text and after of a turn, with loss flags."""
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    role = turn["role"]
    name = F.concat(F.lit(OTHER[0]), escape(role, t), F.lit(OTHER[1]))
    before, after = name, F.lit(OTHER[2])
    for r, a, b in t.marks:
        before = F.when(role == r, F.lit(a)).otherwise(before)
        after = F.when(role == r, F.lit(b)).otherwise(after)
    return F.array(seg(before, no), seg(escape(turn["text"], t), role.isin(*t.loss)), seg(after, no))


def _next_state(state: Column, role: Column, t: Template) -> Column:
    out = F.lit("error")
    for a, r, b in t.moves:
        out = F.when((state == a) & (role == r), F.lit(b)).otherwise(out)
    return out


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>,
    formatted, valid, first_error (index of the first turn that breaks the
    order, null if none does)."""
    empty = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    chats = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broke"))

    def step(acc: Column, x: Column) -> Column:
        state = _next_state(acc["state"], x["role"], template)
        broke = F.when((state == "error") & acc["broke"].isNull(), acc["at"]).otherwise(acc["broke"])
        return F.struct(state.alias("state"), (acc["at"] + 1).alias("at"), broke.alias("broke"))

    return (chats
            .withColumn("segments", F.flatten(F.transform("turns", lambda x: _segments(x, template))))
            .withColumn("run", F.aggregate("turns", start, step))
            .select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    (F.col("run.broke").isNull() & F.col("run.state").isin(*template.final)).alias("valid"),
                    F.col("run.broke").alias("first_error")))


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    shapes = [(a, b) for _, a, b in template.marks] + [(OTHER[0], OTHER[2])]
    pattern = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in shapes)

    def turn(m: Column) -> Column:
        inside = lambda a, b: F.substring(m, F.lit(len(a) + 1), F.length(m) - len(a) - len(b))
        body = inside(OTHER[0], OTHER[2])
        cut = F.locate(OTHER[1], body)
        role, text = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + len(OTHER[1]), F.length(body))
        for r, a, b in template.marks:
            role = F.when(F.startswith(m, F.lit(a)), F.lit(r)).otherwise(role)
            text = F.when(F.startswith(m, F.lit(a)), inside(a, b)).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
