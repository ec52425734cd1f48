"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says, for each role, what stands before and after a text and whether the
text counts for the loss.  Characters that can begin one of the template's control
strings are escaped inside roles and texts, so that no control string ever comes from
a text and the texts can be read back exactly.  All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + close + text + end for each turn.

    reserved: strings that mean something to a tokenizer and must not come from a text either.
    escapes: character -> its escape; the escape character itself comes first.
    moves: state -> roles that may follow; the state is the last role, "start" at first.
    loss: roles whose texts are learnt.
    """

    open: str = "<|turn:"
    close: str = "|>"
    end: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    escapes: dict[str, str] = field(default_factory=lambda: {"~": "~0", "<": "~1", "[": "~2", "|": "~3"})
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    loss: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        loose = [s for s in (self.open, self.close, self.end, *self.reserved) if s[0] not in self.escapes]
        if loose:
            raise ValueError(f"control strings whose first character is not escaped: {loose}")

    def escape(self, text: Column) -> Column:
        for char, to in self.escapes.items():
            text = F.replace(text, F.lit(char), F.lit(to))
        return text

    def unescape(self, text: Column) -> Column:
        for char, to in reversed(self.escapes.items()):
            text = F.replace(text, F.lit(to), F.lit(char))
        return text


CHAT = Template()


def format_chats(turns: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_turns, valid, formatted, segments), one row per conversation.

    segments: array of (text, loss), which put end to end are formatted; a turn gives its
    opening, its text and its end.  valid: whether each role may follow the one before
    and the last turn is one that is learnt.  Turns go by turn number, then role, then text (null
    first), so that ties and repeated rows have one order; repeated rows stay.  Null text
    and null role count as empty, an empty role fits no move, and null conversation ids
    are one conversation.  An empty table gives an empty one.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")))).alias("turns"))
    moves = F.create_map(*[y for k, v in template.moves.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    last = F.aggregate("turns", F.lit("start"), lambda state, t: F.when(F.coalesce(F.array_contains(moves[state], t["role"]), F.lit(False)), t["role"]).otherwise(F.lit("")))
    segments = F.flatten(
        F.transform("turns", lambda t: F.array(
            F.struct(F.concat(F.lit(template.open), template.escape(t["role"]), F.lit(template.close)).alias("text"), F.lit(False).alias("loss")),
            F.struct(template.escape(t["text"]).alias("text"), t["role"].isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        ))
    )
    out = rows.select("conv", F.size("turns").cast("long").alias("n_turns"), last.isin(*template.loss).alias("valid"), segments.alias("segments"))
    return out.select("conv", "n_turns", "valid", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """Array of (role, text), parsed from a formatted conversation alone."""
    quote = lambda s: rf"\Q{s}\E"
    parts = F.split(formatted, quote(template.end), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    skip = len(template.open) + 1

    def parse(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(skip)), template.close, 1)
        text = F.substr(part, F.length(role) + F.lit(skip + len(template.close)))
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    return F.transform(parts, parse)


def loss_text(formatted: Column, segments: Column, template: Template = CHAT) -> Column:
    """The text under the loss mask, unescaped, cut out of formatted by the segments' lengths.

    formatted is split at the turns' ends, which no text contains, so that a cut counts characters within its own turn only.
    """
    turns = F.split(formatted, rf"\Q{template.end}\E", -1)
    heads, texts = F.filter(segments, lambda _, i: i % 3 == 0), F.filter(segments, lambda _, i: i % 3 == 1)
    each = F.filter(F.arrays_zip(turns.alias("turn"), heads.alias("head"), texts.alias("text")), lambda x: x["text"]["loss"])
    cut = lambda x: F.substr(x["turn"], F.length(x["head"]["text"]) + F.lit(1), F.length(x["text"]["text"]))
    return F.array_join(F.transform(each, lambda x: template.unescape(cut(x))), "")
