"""Chat formatting from a declarative template (DataFrame operations only).

A finite-state machine over the roles checks the order of turns.  Each turn becomes three
segments (opening mark, escaped text, closing mark), each with a loss flag.  Control
strings inside texts are escaped by a backslash after their first character, backslashes
are doubled, so the text between two marks can never hold a mark and reading back is exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """Marks around one role's text, and whether the text is trained on."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks for any other role, and the machine that checks the order.

    ``order`` maps a state to the roles it takes and the states they lead to; ``final`` names
    the states a conversation may end in.  ``naming`` and ``named`` stand around the name of a
    role that has no marks of its own.
    """

    roles: dict[str, Turn]
    order: dict[str, dict[str, str]]
    final: frozenset[str]
    start: str = "start"
    naming: str = "<|role|>"
    named: str = "<|text|>"
    closing: str = "<|end|>"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [self.naming, self.named, self.closing, *(m for t in self.roles.values() for m in (t.opening, t.closing))]
        controls = tuple(sorted({m.strip() for m in marks}))
        if any(len(c) < 2 or ESCAPE in c for c in controls):
            raise ValueError("a mark needs two characters at least and no backslash")
        if any(a != b and a.startswith(b) for a in controls for b in controls):
            raise ValueError("no mark may begin with another")
        openings = [self.naming, *(t.opening for t in self.roles.values())]
        if len(set(openings)) < len(openings):
            raise ValueError("opening marks must differ")
        object.__setattr__(self, "controls", controls)

    @property
    def any_control(self) -> str:
        return "(?:" + "|".join(re.escape(c) for c in self.controls) + ")"


#: The production template: an optional system turn, then user and assistant in turn.
INSTRUCT = Template(
    roles={
        "system": Turn("<<SYS>> ", " <</SYS>>"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>", loss=True),
    },
    order={
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    final=frozenset({"answered"}),
)


def escape(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, f"(?s)(?={template.any_control})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def walk(roles: Column, template: Template) -> Column:
    """The state after each conversation and the 0-based number of the first turn out of order (or null)."""
    def move(acc, role):
        to = F.lit("")  # no state: nothing leads on from here
        for state, takes in template.order.items():
            for name, then in takes.items():
                to = F.when((acc.state == state) & (role == name), F.lit(then)).otherwise(to)
        return F.struct(
            to.alias("state"),
            (acc.n + 1).alias("n"),
            F.coalesce(acc.bad, F.when(to == "", acc.n)).alias("bad"),
        )

    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(roles, zero, move)


def segments(turns: Column, template: Template) -> Column:
    """Segments of struct(text, loss): three for each turn."""

    def pieces(t):
        opening = F.concat(F.lit(template.naming), escape(t.role, template), F.lit(template.named))
        closing, loss = F.lit(template.closing), F.lit(False)
        for role, marks in template.roles.items():
            own = t.role == role
            opening = F.when(own, F.lit(marks.opening)).otherwise(opening)
            closing = F.when(own, F.lit(marks.closing)).otherwise(closing)
            loss = F.when(own, F.lit(marks.loss)).otherwise(loss)
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(opening, F.lit(False)), piece(escape(t.text, template), loss), piece(closing, F.lit(False)))

    return F.flatten(F.transform(turns, pieces))


def format_chat(
    rows: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments, formatted, valid, bad_turn.

    Rows are taken by turn; equal turns by role, then text; a null turn comes first; repeated
    rows stay.  A null role or text counts as empty.  Rows with a null conversation form one
    conversation.  Roles that the template does not know are written by name and read back.
    ``valid`` is true if the machine takes every turn and ends in a final state; ``bad_turn``
    is the number of the first turn it does not take.  Conversations out of order are
    formatted like any other: the caller decides.  Other columns are ignored.

    Scale: one shuffle by conversation; a conversation must fit a row, as its text must.
    """
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    made = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        segments(F.col("turns"), template).alias("segments"),
        walk(F.transform("turns", lambda t: t.role), template).alias("walked"),
    )
    return made.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        (F.col("walked.bad").isNull() & F.col("walked.state").isin(*template.final)).alias("valid"),
        F.col("walked.bad").alias("bad_turn"),
    )


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted text as array of struct(role, text)."""
    openings = [template.naming, *(t.opening for t in template.roles.values())]
    cut = F.split(formatted, "(?=" + "|".join(re.escape(o) for o in openings) + ")")

    def turn(piece):
        inner = lambda a, b: F.substring(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))
        body = inner(template.naming, template.closing)
        at = F.instr(body, template.named)
        role = unescape(F.substring(body, F.lit(1), at - 1))
        said = F.substring(body, at + len(template.named), F.length(body))
        for name, marks in template.roles.items():
            own = F.startswith(piece, F.lit(marks.opening))
            role = F.when(own, F.lit(name)).otherwise(role)
            said = F.when(own, inner(marks.opening, marks.closing)).otherwise(said)
        return F.struct(role.alias("role"), unescape(said).alias("text"))

    return F.transform(F.filter(cut, lambda p: F.length(p) > 0), turn)


def loss_text(of: Column) -> Column:
    """All text under the loss mask of ``segments``, unescaped, in order."""
    return F.array_join(F.transform(F.filter(of, lambda s: s.loss), lambda s: unescape(s.text)), "")
