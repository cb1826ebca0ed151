"""Conversations to training text: a state machine over roles and a declarative template.

Native: column expressions only. The turns of a conversation are gathered into one row,
because the result is one row: a conversation is bounded as a document is, by the size of
a row. Texts are escaped so that no marker of the template can occur inside one, and the
escape is undone exactly by :func:`read_back`.

Defined cases: a null text is empty; a null role reads as the empty role; an undeclared
role is written out, makes the conversation invalid and is never under the loss. Turns are
ordered by (turn, role, text), nulls first, so ties and repeated rows have one order and
all stay. Rows without conversation id form one conversation with a null id. Further
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class RoleFormat:
    """How a role is labelled, and whether its texts are under the loss."""
    label: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, roles and the state machine: state -> role -> next state."""
    roles: Mapping[str, RoleFormat] = field(default_factory=lambda: {
        "system": RoleFormat("System"), "user": RoleFormat("User"),
        "assistant": RoleFormat("Assistant", loss=True)})
    transitions: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {
        "start": {"system": "instructed", "user": "asked"},
        "instructed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"}})
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    open_mark: str = "###"
    separator: str = ": "
    close_mark: str = "</turn>"
    undeclared: str = "?"


def _broken(text: Column, control: str) -> Column:
    """A backslash after the first character of every occurrence, overlapping ones included."""
    first, rest = control[0], control[1:]
    return F.regexp_replace(text, f"{re.escape(first)}(?={re.escape(rest)})", "$0\\\\")


def escaped(text: Column, *controls: str) -> Column:
    """The text without any of the control strings; they must not hold a backslash."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in controls:
        out = _broken(out, control)
    return out


def unescaped(text: Column) -> Column:
    """Undoes :func:`escaped`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _lookup(pairs: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _texts_between_marks(template: ChatTemplate, text: Column) -> Column:
    return escaped(text, template.open_mark, template.close_mark)


def _segments(template: ChatTemplate, turn: Column) -> Column:
    """Opening marker, text and closing marker of a turn, each with its loss flag."""
    labels = _lookup({role: f.label for role, f in template.roles.items()})
    trained = [role for role, f in template.roles.items() if f.loss]
    named = F.coalesce(F.try_element_at(labels, turn["role"]), F.concat(
        F.lit(template.undeclared),
        escaped(turn["role"], template.open_mark, template.close_mark, template.separator)))
    opening = F.concat(F.lit(f"{template.open_mark} "), named, F.lit(template.separator))
    parts = ((opening, F.lit(False)),
             (_texts_between_marks(template, turn["text"]), turn["role"].isin(trained)),
             (F.lit(f"{template.close_mark}\n"), F.lit(False)))
    return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])


def _walk(template: ChatTemplate, turns: Column) -> Column:
    """The state after the last turn, and the number of the first turn that has no transition."""
    step = _lookup({f"{state}\n{role}": following
                    for state, row in template.transitions.items()
                    for role, following in row.items()})

    def read(at: Column, turn: Column) -> Column:
        following = F.try_element_at(step, F.concat_ws("\n", at["state"], turn["role"]))
        failed = F.when(at["failed"].isNotNull(), at["failed"]).when(
            following.isNull(), at["read"])
        return F.struct(F.coalesce(following, at["state"]).alias("state"),
                        failed.alias("failed"), (at["read"] + 1).alias("read"))

    begin = F.struct(F.lit(template.start).alias("state"),
                     F.lit(None).cast("int").alias("failed"), F.lit(0).alias("read"))
    return F.aggregate(turns, begin, read)


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (text, loss), formatted, valid,
    failed_turn (number from 0 of the first turn out of order, null if there is none)."""
    template = template or ChatTemplate()
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    walked = gathered.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("_turns", lambda t: _segments(template, t))).alias("segments"),
        _walk(template, F.col("_turns")).alias("_end"))
    return walked.select(
        "conv_id", "n_turns", "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        (F.col("_end.failed").isNull() & F.col("_end.state").isin(*template.final)).alias("valid"),
        F.col("_end.failed").alias("failed_turn"))


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) of a formatted conversation, with the texts as they were."""
    template = template or ChatTemplate()
    roles = _lookup({f.label: role for role, f in template.roles.items()})
    head = f"(?s)^{re.escape(template.open_mark)} (.*?){re.escape(template.separator)}(.*)$"

    def turn(piece: Column) -> Column:
        label = F.regexp_extract(piece, head, 1)
        other = unescaped(F.substring(label, 1 + len(template.undeclared), 1 << 30))
        return F.struct(F.coalesce(F.try_element_at(roles, label), other).alias("role"),
                        unescaped(F.regexp_extract(piece, head, 2)).alias("text"))

    pieces = F.split(formatted, re.escape(f"{template.close_mark}\n"), -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescaped(s["text"])), "")
