"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes one training example: all turns before it are context, and only its text is trainable. Turns after
the last assistant turn (or all, where there is none) come out as one more example without a trainable span, so that the
formatted output holds every turn.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn, nothing between turns. Control strings all begin with ``<|``. Inside
roles and texts a ``<`` that is followed by any number of backslashes and a ``|`` gets one backslash more, which ``unescape``
takes away; everything else stays as it is, and no ``<|`` is left in a role or text.

Defined results: a null role or text is the empty string. Turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows are in a fixed order and each row is a turn. Rows with a null conv_id form one conversation. A conversation is one row while
its prefixes are made, as its digest asks for the whole text; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _formatted_turn(turn: Column) -> Column:
    return F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT), escape(turn["text"]), F.lit(END))


def examples(conversations: DataFrame, target_role: str = ASSISTANT) -> DataFrame:
    """(conv_id, example, formatted, trainable, loss_start, loss_end), one row per example.

    ``example`` is the number of turns it holds; [loss_start, loss_end) are code points of ``formatted``, empty where
    ``trainable`` is false.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = (
        conversations.select("conv_id", "turn", text("role"), text("text"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    targets = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.element_at("turns", i)["role"] == target_role) | (i == F.size("turns")),
    )
    pieces = turns.select("conv_id", "turns", F.transform("turns", _formatted_turn).alias("pieces"))
    expanded = pieces.select("conv_id", "turns", "pieces", F.explode(targets).alias("example"))
    target = F.element_at("turns", F.col("example"))
    made = expanded.select(
        "conv_id", "example",
        F.array_join(F.slice("pieces", 1, F.col("example")), "").alias("formatted"),
        (target["role"] == target_role).alias("trainable"),
        F.length(escape(target["text"])).alias("_reply"),
    )
    end = F.length("formatted") - len(END)
    return made.select(
        "conv_id", "example", "formatted", "trainable",
        F.when(F.col("trainable"), end - F.col("_reply")).otherwise(end).alias("loss_start"), end.alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    marked = F.split(formatted, r"<\|end\|>")
    return F.transform(
        F.slice(marked, 1, F.size(marked) - 1),
        lambda piece: F.struct(
            unescape(F.substring_index(F.substring(piece, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"),
            unescape(F.element_at(F.split(piece, r"<\|text\|>"), 2)).alias("text"),
        ),
    )


def trainable_text() -> Column:
    """The unescaped text under the loss mask of an example."""
    return unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns, digests, and characters of the loss mask and of all examples."""
    reply = F.struct("example", trainable_text().alias("text"))
    whole = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), reply))).alias("replies"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
    )
    read = whole.select(
        "conv_id", "formatted_chars", parse(F.col("whole")).alias("turns"),
        F.array_join(F.transform("replies", lambda r: r["text"]), "").alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
