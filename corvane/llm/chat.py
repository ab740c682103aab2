"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template gives each role an opening mark, a closing mark and a loss flag.
Every turn becomes three segments (mark, text, mark) with a loss flag each, and
a conversation's formatted text is its segments joined. Inside texts the
characters that begin a mark are escaped, so that a text can never open or
close a turn, and the formatted text can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Role:
    name: str
    opens: str
    closes: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """Marks by role, the order of turns, and what any other role's turns look like.

    ``follows[state]`` lists the roles that may come next; ``ends`` the roles a
    whole conversation may end with. Each mark begins with ``<`` or ``[``.
    """

    roles: tuple[Role, ...]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    other_opens: str = "<role:"
    other_closes: str = " </role>\n"


INSTRUCT = Template(
    roles=(
        Role("system", "<<SYS>>\n", "\n<</SYS>>\n", False),
        Role("user", "[INST] ", " [/INST]", False),
        Role("assistant", "<s> ", " </s>\n", True),
    ),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)
#: Each begins with the escape character, so undoing them in reverse order is exact.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), (">", "\\g"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _opens(template: Template, role: Column) -> Column:
    out = F.concat(F.lit(template.other_opens), escape(role), F.lit("> "))
    for r in template.roles:
        out = F.when(role == r.name, F.lit(r.opens)).otherwise(out)
    return out


def _closes(template: Template, role: Column) -> Column:
    out = F.lit(template.other_closes)
    for r in template.roles:
        out = F.when(role == r.name, F.lit(r.closes)).otherwise(out)
    return out


def _valid(template: Template, roles: Column) -> Column:
    def step(state: Column, role: Column) -> Column:
        allowed = [(state == s) & role.isin(*names) for s, names in template.follows.items() if names]
        ok = allowed[0]
        for a in allowed[1:]:
            ok = ok | a
        return F.when(ok, role).otherwise(F.lit(BROKEN))

    return F.aggregate(roles, F.lit(START), step, lambda s: s.isin(*template.ends))


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``(conv_id, valid, segments, formatted)``, a row for each conv_id of ``turns(conv_id, turn, role, text)``.

    ``segments`` is an array of ``(text, loss)``; ``formatted`` is their texts
    joined; ``valid`` says whether the roles follow the template's order.
    Conversations in a wrong order are formatted too. Turns are ordered by
    (turn, role, text), so ties and repeated rows have one defined order, null
    turns first. Null texts and roles count as empty; null conv_ids form one
    conversation; unknown roles get the template's other marks; further
    columns are ignored; an empty table gives an empty result. A conversation
    is one training sample and so is gathered in one row.
    """
    loss_roles = [r.name for r in template.roles if r.loss]
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                segment(_opens(template, t["role"]), F.lit(False)),
                segment(escape(t["text"]), t["role"].isin(*loss_roles)),
                segment(_closes(template, t["role"]), F.lit(False)),
            ),
        )
    )
    made = grouped.select("conv_id", _valid(template, F.transform("ts", lambda t: t["role"])).alias("valid"), segments.alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _mark_pattern(template: Template) -> str:
    quoted = [f"\\Q{m}\\E" for m in [*(r.opens for r in template.roles), template.other_opens]]
    return f"(?={'|'.join(quoted)})"


def parse_formatted(formatted: Column, template: Template = INSTRUCT) -> Column:
    """Array of ``(role, text)`` read back from a formatted text."""

    def turn(piece: Column) -> Column:
        head = F.instr(piece, "> ")
        role = unescape(F.substring(piece, F.lit(len(template.other_opens) + 1), head - len(template.other_opens) - 1))
        body = F.substring(piece, head + 2, F.char_length(piece) - head - 1 - len(template.other_closes))
        for r in template.roles:
            mine = piece.startswith(r.opens)
            cut = F.substring(piece, F.lit(len(r.opens) + 1), F.char_length(piece) - len(r.opens) - len(r.closes))
            role, body = F.when(mine, F.lit(r.name)).otherwise(role), F.when(mine, cut).otherwise(body)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.split(formatted, _mark_pattern(template)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
