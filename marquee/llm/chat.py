"""Chat formatting by a declarative template and a finite-state machine over roles.

The template names the heads and the end mark of a turn and the roles under the loss. Control strings inside texts
are broken up by a backslash after their first character and backslashes are doubled, so a head or
an end mark occurs in the output only where the template put it, and reading back is a plain split.

The machine is a table state x role -> state; an entry that is missing leads to `bad`, from which
nothing leads away. It is folded over the roles of a conversation in turn order; a conversation is
valid if no turn was bad and it ends in an accepting state.

Only column expressions are used. A conversation's text is one value of the result, so its turns
meet in one row; nothing else is grouped.

Defined results: a null text is empty; a null role is the empty role; roles that the template does
not name are written by their own names and are invalid; turns with equal numbers are ordered by
role and text, null numbers come first; repeated rows are turns of their own; a null conv_id is a
conversation of its own; further columns of the input are left out, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Heads by role, the end mark of a turn, the roles under the loss, and the role machine."""

    heads: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other_head: tuple = ("### Role ", ": ")
    end: str = " </turn>\n"
    #: Parts of heads and end that may not occur in a text; each is broken after its first character.
    control: tuple = ("###", "</turn>")
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    moves: dict = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple = ("answered",)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.control:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def segments_of(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, segments (array of role, text, loss) and the end state.

    A turn gives three segments: its head, its escaped text, its end mark; only the text of a role
    under the loss has loss = true.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = _map(template.heads)[role]
    head = F.coalesce(named, F.concat(F.lit(template.other_head[0]), F.replace(escape(role, template), F.lit(":"), F.lit("\\:")), F.lit(template.other_head[1])))
    loss = role.isin(*template.loss_roles)
    one = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), loss.alias("loss"))
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    moves = _map({f"{a}\x00{b}": c for (a, b), c in template.moves.items()})

    def step(state, t):
        return F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\x00"), t["role"])), F.lit("bad"))

    def cut(t):
        return F.array(
            F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), t["loss"].alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    return whole.select(
        "conv_id",
        F.aggregate("ts", F.lit(template.start), step).alias("state"),
        F.flatten(F.transform("ts", cut)).alias("segments"),
    )


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted (the text to train on), segments (text, loss), state, is_valid."""
    return segments_of(turns, template).select(
        "conv_id",
        F.concat_ws("", F.col("segments.text")).alias("formatted"),
        "segments",
        "state",
        F.col("state").isin(*template.accepting).alias("is_valid"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds turns (array of role, text) parsed from `formatted`, and loss_text from the segments' flags."""
    pieces = F.split("formatted", re.escape(template.end), -1)
    # What follows the last end mark is empty by construction.
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    other, close = template.other_head

    def parse(body):
        # An own name holds no unescaped colon, so it ends at the first close mark without a backslash before.
        tail = F.regexp_extract(body, r"(?s)^" + re.escape(other) + r"((?:[^\\:]|\\.)*+)" + re.escape(close), 0)
        name = unescape(F.substring(tail, F.lit(len(other) + 1), F.length(tail) - len(other) - len(close)))
        role, text = name, F.substring(body, F.length(tail) + 1, F.length(body))
        for known, head in template.heads.items():
            hit = F.startswith(body, F.lit(head))
            role = F.when(hit, F.lit(known)).otherwise(role)
            text = F.when(hit, F.substring(body, F.lit(len(head) + 1), F.length(body))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    under = F.filter("segments", lambda s: s["loss"])
    return formatted.withColumn("turns", F.transform(bodies, parse)).withColumn("loss_text", F.concat_ws("", F.transform(under, lambda s: unescape(s["text"]))))


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and hashes of what was read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(formatted, template).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "is_valid",
    )
