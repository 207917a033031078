"""Chat formatting: conversations to one training text each, with a loss mask.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role
are merged into a block by an array aggregation, and the blocks are concatenated.  Everything
is a Spark expression.

The format of a block is ``<|turn|>role<|text|>text<|more|>text<|end|>`` and a line feed.  In
roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so a control string in a text
never reads as one, and ``read_back`` gets every turn as it was.

The text is kept in segments, each under the loss mask or not; joined they are the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm.columns import let

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _blocks(turns: Column) -> Column:
    """Sorted turns to array<struct<role, texts>>, adjacent turns of one role together."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(turns)),
        lambda i: (i == F.size(turns))
        | (i == 0)
        | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]),
    )
    return let(
        starts,
        lambda at: F.transform(
            F.slice(at, 1, F.size(at) - 1),
            lambda first, k: F.struct(
                F.get(turns, first)["role"].alias("role"),
                F.transform(
                    F.slice(turns, first + 1, F.get(at, k + 1) - first), lambda turn: turn["text"]
                ).alias("texts"),
            ),
        ),
    )


def _segments(blocks: Column) -> Column:
    """Blocks to array<struct<text, loss>>."""

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_block(block: Column) -> Column:
        learned = block["role"] == LEARNED_ROLE
        head = F.concat(F.lit(TURN), escaped(block["role"]), F.lit(TEXT))
        parts = F.flatten(
            F.transform(
                block["texts"],
                lambda text, k: F.array(
                    segment(F.when(k == 0, head).otherwise(F.lit(MORE)), F.lit(False)),
                    segment(escaped(text), learned),
                ),
            )
        )
        return F.concat(parts, F.array(segment(F.lit(END), F.lit(False))))

    return F.flatten(F.transform(blocks, of_block))


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, formatted, segments.

    Turns are sorted by turn, NULL first, then by role and text; NULL roles and texts are
    empty ones.  Rows without conv_id make up one conversation.  Repeated rows are repeated
    turns.  A conversation becomes one cell, so it must fit one.
    """
    empty = F.lit("")
    turns = F.sort_array(
        F.collect_list(
            F.struct(
                F.col("turn").alias("turn"),
                F.coalesce("role", empty).alias("role"),
                F.coalesce("text", empty).alias("text"),
            )
        )
    )
    per = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(turns.alias("turns"))
    segments = let(let(F.col("turns"), _blocks), _segments)
    return per.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments"
    )


def read_back(text: Column) -> Column:
    """A formatted text to array<struct<role, text>>, one struct per original turn."""

    def of_block(block: Column) -> Column:
        body = F.substring_index(block, TEXT, -1)
        role = F.substring(F.substring_index(block, TEXT, 1), len(TURN) + 1, 2_147_483_647)
        return F.transform(
            F.split(body, r"<\|more\|>"),
            lambda part: F.struct(unescaped(role).alias("role"), unescaped(part).alias("text")),
        )

    blocks = F.filter(F.split(text, r"<\|end\|>\n"), lambda block: block != "")
    return F.flatten(F.transform(blocks, of_block))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    inside = F.filter(segments, lambda segment: segment["loss"])
    return F.array_join(F.transform(inside, lambda segment: unescaped(segment["text"])), "")


#: The conversation that the contract adds: its texts hold an escape and a control string.
ADDED = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def with_added(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    def row(conv_id: int, turn: int, role: str, text: str) -> DataFrame:
        return spark.range(1).select(
            F.lit(conv_id).cast("bigint").alias("conv_id"),
            F.lit(turn).cast("bigint").alias("turn"),
            F.lit(role).alias("role"),
            F.lit(text).alias("text"),
        )

    given = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    return reduce(DataFrame.unionByName, (row(*values) for values in ADDED), given)


def digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The rows of the query: what is read back from the formatted conversations."""
    done = formatted(with_added(spark, conversations))
    read = done.select(
        "conv_id",
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        read_back(F.col("formatted")).alias("turns"),
        learned_text(F.col("segments")).alias("learned"),
    )
    listing = F.array_join(
        F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
