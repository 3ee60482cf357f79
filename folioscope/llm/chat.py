"""Chat formatting with Spark expressions only.

One conversation becomes one string of turns::

    <|turn|>ROLE<|role|>TEXT[<|join|>TEXT ...]<|end|>

Adjacent turns of one role share a ``<|turn|> ... <|end|>`` frame; ``<|join|>`` stands between their texts, so
nothing is lost by merging. Control strings inside roles and texts, those of other templates too, are escaped by
a backslash after their first character (a backslash itself is doubled), which makes the format reversible.

The loss mask comes as ``segments``: the formatted string cut into pieces, each with a flag that is true for
assistant texts. All arrays are built by ``transform`` over an index, so the work is linear in a conversation.

Defined results: a null text or role counts as empty; rows with a null conv_id form one conversation; a null turn
sorts first; rows with the same turn sort by role, then text, and repeated rows all stay; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import only, text_or_empty

TURN, ROLE, JOIN, END = "<|turn|>", "<|role|>", "<|join|>", "<|end|>"
#: Own control strings, then those of common templates.
CONTROL = (TURN, ROLE, JOIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_INSIDE = r"(?<=[<\[])(?=" + "|".join(re.escape(x[1:]) for x in CONTROL) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _INSIDE, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>> for each conversation."""
    rows = only(turns, conv_id=conv_id, turn=turn, role=role, text=text).select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    at = lambda i: F.get(F.col("turns"), i)["role"]

    def pieces(t: Column, i: Column) -> Column:
        opens = (i == 0) | (at(i - 1) != t["role"])
        closes = (i == F.size("turns") - 1) | (at(i + 1) != t["role"])
        head = F.when(opens, F.concat(F.lit(TURN), escape(t["role"]), F.lit(ROLE))).otherwise(F.lit(JOIN))
        tail = F.when(closes, F.lit(END)).otherwise(F.lit(""))
        part = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(t["text"]), t["role"] == train_role), part(tail, F.lit(False)))

    segments = F.filter(F.flatten(F.transform("turns", pieces)), lambda s: (s["text"] != "") | s["loss"])
    return grouped.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted string was made of."""
    frames = F.filter(F.split(formatted, re.escape(END)), lambda f: f != "")

    def turns_of(frame: Column) -> Column:
        halves = F.split(F.substring(frame, len(TURN) + 1, 2**31 - 1), re.escape(ROLE))
        return F.transform(F.split(halves[1], re.escape(JOIN)), lambda t: F.struct(unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(frames, turns_of))


def masked_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from format_conversations()' output."""
    read = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), masked_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
