"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

Turns of a conversation become segments ``(text, loss)``. Control strings inside texts are escaped, so that the output
can be read back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn; ``<|`` begins every mark, and nothing else in the output. Texts of ``loss_roles`` bear loss."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> states that may follow; a state is a role, '' the start.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not self.open.startswith("<|") or not self.close.startswith("<|"):
            raise ValueError("marks begin with <|")
        if self.after_role != "\n":
            raise ValueError("a role ends with a line feed")


def escape(text: Column) -> Column:
    """Put a backslash after each ``<`` that a bar or a backslash follows; then no mark can occur in the text."""
    return F.regexp_replace(text, r"<(?=[\\|])", r"<\\")


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and a line feed becomes ``<n``."""
    return F.replace(F.regexp_replace(role, r"<(?=[\\|n])", r"<\\"), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, n_turns, valid, first_bad, segments, formatted)``.

    valid: every move is one of the template's and the last state may end; first_bad: index of the first turn that is
    no such move (null if none). Turns stand in order of turn (nulls first), then role and text; repeated rows are turns
    of their own. A null text or role is empty. A null conv_id is a conversation of its own. No rows give no rows. A conversation's turns meet in one row, as the result
    is one text; a conversation is as long as its text, however many conversations share their words.
    """
    t = template
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    allowed = F.create_map(*[x for state, to in t.moves.items() for x in (F.lit(state), F.array(*map(F.lit, to)))])
    start = F.struct(F.lit("").alias("state"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("bad"))

    def move(s: Column, turn: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.try_element_at(allowed, s["state"]), turn["role"]), F.lit(False))
        at = s["at"] + 1
        return F.struct(turn["role"].alias("state"), at.alias("at"), F.when(s["bad"].isNotNull(), s["bad"]).when(~ok, at).alias("bad"))

    machine = F.aggregate("turns", start, move)

    def emit(turn: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(t.open), escape_role(turn["role"]), F.lit(t.after_role))
        return F.array(seg(head, F.lit(False)), seg(escape(turn["text"]), turn["role"].isin(*t.loss_roles)), seg(F.lit(t.close), F.lit(False)))

    out = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), machine.alias("m"), F.flatten(F.transform("turns", emit)).alias("segments"))
    valid = F.col("m.bad").isNull() & F.col("m.state").isin(*t.ends)
    return out.select("conv_id", "n_turns", valid.alias("valid"), F.col("m.bad").alias("first_bad"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns as ``array<struct<role, text>>``, and the texts under the loss mask, from the output of ``format_conversations``."""
    t = template
    quoted = "\\Q" + t.open + "\\E"

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(1), F.length(piece) - len(t.close))
        role = F.substring_index(body, t.after_role, 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 1 + len(t.after_role))).alias("text"))

    parts = F.split("formatted", quoted, -1)
    return formatted.withColumns({"turns": F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn), "loss_texts": F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))})
