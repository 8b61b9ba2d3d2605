"""Operator 6: chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, neighbours of one role become one block, and the
blocks are concatenated. Every mark starts with ``<|``; inside texts and roles a backslash is
doubled and ``<|`` is written ``<\\|``, so no text can make a mark and all of it can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm import prefixes

START, BODY, JOIN, END = "<|start|>", "<|body|>", "<|join|>", "<|end|>\n"
#: The role whose texts are under the loss mask.
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """A text in which no mark can occur."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _blocks(turns: Column) -> Column:
    """Runs of turns of one role: ``array<struct<role, texts>>``."""
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(turns, s - 1)["role"].alias("role"),
            F.transform(F.slice(turns, s, F.coalesce(F.get(starts, k + 1), F.size(turns) + 1) - s), lambda t: t["text"]).alias("texts"),
        ),
    )


def _segments(block: Column) -> Column:
    """What a block writes: strings with whether they are under the loss mask."""
    trained = block["role"] == TRAINED
    plain = lambda x: F.struct(x.alias("s"), F.lit(False).alias("loss"))
    texts = F.flatten(
        F.transform(
            block["texts"],
            lambda t, i: F.array(plain(F.when(i == 0, F.lit("")).otherwise(F.lit(JOIN))), F.struct(escape(t).alias("s"), trained.alias("loss"))),
        )
    )
    head = plain(F.concat(F.lit(START), escape(block["role"]), F.lit(BODY)))
    return F.concat(F.array(head), texts, F.array(plain(F.lit(END))))


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, formatted, loss)``: one row for each conversation; ``loss`` has start and length in code points.

    Turns are sorted by turn, then role, then text; rows that repeat a turn all stay. A null role or text is
    empty, a null turn comes first, and rows with a null conversation form one. An empty table gives no rows. Other
    columns are not read. A conversation is one row, so its turns meet in one task and must fit in it.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = sorted_turns.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    parts = parts.select("conv_id", F.flatten(F.transform("blocks", _segments)).alias("parts"))
    parts = parts.select("conv_id", F.transform("parts", lambda p: p["s"]).alias("written"), F.transform("parts", lambda p: p["loss"]).alias("trained"), F.transform("parts", lambda p: F.length(p["s"])).alias("sizes"))
    places = F.arrays_zip(prefixes.sums_before(F.col("sizes")).alias("at"), F.col("sizes").alias("size"), F.col("trained").alias("trained"))
    loss = F.transform(F.filter(places, lambda p: p["trained"]), lambda p: F.struct((p["at"] + 1).alias("start"), p["size"].alias("length")))
    return parts.select("conv_id", F.array_join("written", "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(START) + 1, 2**31 - 1), BODY, 1)
        body = F.split(F.substring_index(block, BODY, -1), r"<\|join\|>")
        return F.transform(body, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda m: unescape(F.substring(formatted, m["start"], m["length"])))
