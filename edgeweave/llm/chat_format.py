"""Chat formatting (operator 8): a relational template over collected turn structs.

A conversation becomes one string.  Adjacent turns of one role share a block:

    <|im_start|>ROLE\\nTEXT(<|im_sep|>TEXT)*<|im_end|>\\n

Only control strings start with ``<|`` in the output: a text's ``<|`` is written ``<\\|`` and each ``<\\...\\|``
gets one backslash more, which undoing takes away, so any text survives the round trip.  In a role ``%``, ``<``
and the line feed are percent-encoded.

Defined cases: a null text or role is an empty one; a null conv_id is a conversation of its own; equal turn
numbers are ordered by role, then text; null turns come first; repeated rows all stay; an empty table gives an
empty result; further columns are ignored.  The whole operator is Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted string.

    ``formatted`` is the segments' text end to end; ``loss`` marks the segments that a model is trained on:
    exactly the escaped texts of ``loss_role``, without separators.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("turns"), (i - 1).cast("int")))
        opens = F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))
        lead = F.when(i == 0, opens).when(before["role"] == x["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END), opens))
        return F.array(
            F.struct(lead.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape_text(x["text"]).alias("text"), (x["role"] == F.lit(loss_role)).alias("loss")),
        )

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.transform("turns", piece)), last)
    out = turns.select("conv_id", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> parsed from ``formatted``; loss_text, the unescaped text under the mask."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.split(F.substring(block, len(START) + 1, 2147483647), "\n", 2)
        role = unescape_role(F.get(head, F.lit(0)))
        return F.transform(
            F.split(F.get(head, F.lit(1)), r"<\|im_sep\|>", -1),
            lambda t: F.struct(role.alias("role"), unescape_text(t).alias("text")),
        )

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape_text(s["text"]))
    return formatted.select("*", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digest(rows: DataFrame) -> DataFrame:
    """One row per conversation with what the round trip gives back; see op8."""
    back = read_back(format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
