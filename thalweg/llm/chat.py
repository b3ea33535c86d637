"""Chat formatting by a finite-state machine over roles and a declarative template, in DataFrame operations only.

The template says how each role's turns are marked and whether the loss counts their text; the machine says which role may
follow which. A conversation becomes a list of text segments, each with its loss flag. Control strings inside texts are
escaped, so that the formatted string can be read back turn by turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Marks:
    """What stands before and after the text of a turn, and whether the loss counts the text."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: role -> Marks. Turns of any other role, or of none, are marked by `other`, with the role between its
    opening and `named`. moves: (state, role) -> state, from "start"; a conversation is valid if each of its turns has a move and
    the last state is one of `accepting`."""

    roles: dict[str, Marks]
    moves: dict[tuple[str, str], str]
    accepting: frozenset[str]
    other: Marks = Marks("[AS] ", " [/AS]")
    named: str = " [OF] "
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        every = [*self.roles.values(), self.other]
        controls = tuple(sorted({m.strip() for x in every for m in (x.opens, x.closes)} | {self.named.strip()}))
        firsts = {c[0] for c in controls if c}
        if any(len(c) < 2 or ESCAPE in c or any(x in firsts for x in c[1:]) for c in controls):
            raise ValueError("a control string has two characters at least, no backslash, and no character inside that begins one")
        if len({x.opens for x in every}) < len(every) or any(a.opens.startswith(b.opens) for a in every for b in every if a is not b):
            raise ValueError("roles have to be told apart by what opens their turns")
        object.__setattr__(self, "controls", controls)


#: The marks and moves of the default template.
DEFAULT = Template(
    roles={"system": Marks("[SYS] ", " [/SYS]\n"), "user": Marks("[INST] ", " [/INST] "), "assistant": Marks("<s> ", " </s>\n", loss=True)},
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    accepting=frozenset({"assistant"}),
)


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    """Backslashes doubled, and one set behind the first character of each control string: none is left, and none can arise
    across the end of the text, as no character inside a control string begins one."""
    starts = {}
    for c in template.controls:
        starts.setdefault(c[0], []).append(c[1:])
    found = "|".join(f"{re.escape(first)}(?={'|'.join(re.escape(x) for x in rest)})" for first, rest in sorted(starts.items()))
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), f"({found})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def machine(roles: Column, template: Template = DEFAULT) -> Column:
    """roles: ARRAY<STRING> -> the place of the first turn that has no move (the number of turns where the last state does
    not accept), null for a valid conversation."""
    moves = _map({f"{state}\n{role}": to for (state, role), to in template.moves.items()})
    none = F.lit(None).cast("string")
    begun = F.struct(F.lit("start").alias("state"), F.lit(0).alias("done"))

    def move(x, role):
        to = F.try_element_at(moves, F.concat_ws("\n", x["state"], F.coalesce(role, F.lit(""))))
        return F.struct(F.when(x["state"].isNotNull(), to).otherwise(none).alias("state"), (x["done"] + F.when(to.isNotNull() & x["state"].isNotNull(), 1).otherwise(0)).alias("done"))

    return F.aggregate(roles, begun, move, lambda x: F.when(F.coalesce(x["state"].isin(*sorted(template.accepting)), F.lit(False)), F.lit(None)).otherwise(x["done"]))


def segments(turn: Column, template: Template = DEFAULT) -> Column:
    """The (text, loss) segments of a turn struct (role, text): what opens it, the escaped text, what closes it."""
    said = escaped(turn["text"], template)

    def one(text, loss=False):
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def marked(marks: Marks, role: Column | None = None):
        opens = F.lit(marks.opens) if role is None else F.concat(F.lit(marks.opens), escaped(role, template), F.lit(template.named))
        return F.array(one(opens), one(said, marks.loss), one(F.lit(marks.closes)))

    out = marked(template.other, turn["role"])
    for role, marks in template.roles.items():
        out = F.when(turn["role"] == role, marked(marks)).otherwise(out)
    return out


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, segments ARRAY<STRUCT<text, loss>>, formatted (their texts joined), bad_turn.

    Turns come in order of turn_col (null first), equal ones in order of role and text. Null texts and roles are empty. Turns
    of roles that the template does not name are marked by its `other`. bad_turn: see machine(); conversations that are not
    valid are formatted as they are, and left to the caller. Repeated rows are turns of their own. Rows with a null id are
    one conversation. Ids may be of any type; other columns are ignored. Empty table: no rows.

    One exchange, by conversation; a conversation is one row of the result and must fit in one (2 GB in Spark).
    """
    said = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    made = whole.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: segments(t, template))).alias("segments"),
        machine(F.transform("turns", lambda t: t["role"]), template).cast("int").alias("bad_turn"),
    )
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "bad_turn")


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """ARRAY<STRUCT<role, text>>: the turns of a formatted string, unescaped."""
    every = [*template.roles.items(), (None, template.other)]
    pieces = F.filter(F.split(formatted, "(?=" + "|".join(re.escape(m.opens) for _, m in every) + ")"), lambda p: p != "")

    def inside(piece: Column, marks: Marks) -> Column:
        return F.substring(piece, len(marks.opens) + 1, F.length(piece) - (len(marks.opens) + len(marks.closes)))

    def turn(piece: Column) -> Column:
        body = inside(piece, template.other)
        at = F.instr(body, F.lit(template.named))
        out = F.struct(unescaped(F.substring(body, F.lit(1), at - 1)).alias("role"), unescaped(F.substring(body, at + len(template.named), F.length(body))).alias("text"))
        for role, marks in template.roles.items():
            out = F.when(F.startswith(piece, F.lit(marks.opens)), F.struct(F.lit(role).alias("role"), unescaped(inside(piece, marks)).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, turn)


def trained_text(found: Column) -> Column:
    """segments -> all text that the loss counts, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(found, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
