"""Chat formatting with Spark expressions only.

Turns are collected into blocks of ``BLOCK`` turn numbers, so that a conversation of any length is
formatted in bounded pieces; a small table of each block's first and last role tells a block how its
neighbours end and begin. Within a block the turn structs are sorted, and adjacent turns of one role
share a frame:

    <|im_start|>role NEWLINE text <|im_sep|> text <|im_end|> NEWLINE <|im_start|>role ...

Texts and roles are escaped (backslash doubled, ``<|`` as ``<\\|``, in roles a line end as
``<|nl|>``), so no control string of a text survives and all can be read back. ``loss_spans`` are the
(start, length) in code points of each assistant text within its block.

Defined results: null texts and roles are empty; null turns come first; equal turn numbers are
ordered by role, then by a hash of the text and the text; repeated rows stay; the rows of a null
conv_id are one conversation. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
_KEYS = ["no_conv", "conv_key", "no_turn", "block"]


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def format_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, no_turn, block, formatted, loss_spans): the blocks of each conversation; its
    text is their ``formatted`` in the order of (no_turn descending, block)."""
    turns = turns.select(
        F.col("conv_id").isNull().alias("no_conv"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_key"),
        F.col("turn").isNull().alias("no_turn"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(0)).cast("long").alias("block"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    order = Window.partitionBy("no_conv", "conv_key").orderBy(F.desc("no_turn"), "block")
    edges = (turns.groupBy(*_KEYS)
             .agg(F.min(F.struct("turn", "role"))["role"].alias("first"), F.max(F.struct("turn", "role"))["role"].alias("last"))
             .select(*_KEYS, F.lag("last").over(order).alias("before"), F.lead("first").over(order).isNull().alias("at_end")))
    blocks = (turns.groupBy(*_KEYS)
              .agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.xxhash64("text").alias("h"), "text"))).alias("turns"))
              .join(edges, _KEYS))

    def frame(t: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("before")).otherwise(F.get("turns", i - 1)["role"])
        opened = F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
        return F.struct(
            F.when(before.isNull(), opened).when(before == t["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END), opened)).alias("open"),
            escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"))

    def place(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["open"])
        span = F.struct(begin.alias("start"), F.length(x["text"]).alias("length"))
        return F.struct((begin + F.length(x["text"])).alias("at"),
                        F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))
    return (blocks.withColumn("frames", F.transform("turns", frame))
            .select(F.when(~F.col("no_conv"), F.col("conv_key")).alias("conv_id"), "no_turn", "block",
                    F.concat(F.array_join(F.transform("frames", lambda x: F.concat(x["open"], x["text"])), ""),
                             F.when(F.col("at_end"), F.lit(END)).otherwise(F.lit(""))).alias("formatted"),
                    F.aggregate("frames", none, place, lambda acc: acc["spans"]).alias("loss_spans")))


def joined(blocks: DataFrame) -> DataFrame:
    """One row for each conversation: formatted, and loss_text, all text under the loss mask, unescaped."""
    masked = F.array_join(F.transform("loss_spans", lambda s: F.substr("formatted", s["start"] + 1, s["length"])), "")
    part = F.struct((~F.col("no_turn")).alias("later"), "block", "formatted", masked.alias("masked"))
    return (blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
            .select("conv_id", F.array_join(F.col("parts.formatted"), "").alias("formatted"),
                    unescape(F.array_join(F.col("parts.masked"), "")).alias("loss_text")))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted conversation."""

    def turns(framed: Column) -> Column:
        head = F.substring_index(framed, "\n", 1)
        role = _unescape_role(F.substr(head, F.lit(len(START) + 1)))
        texts = F.split(F.substr(framed, F.length(head) + 2), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    frames = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.flatten(F.transform(F.slice(frames, 1, F.size(frames) - 1), turns))
