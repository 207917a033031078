"""Token counts: an exact length histogram and its suffix sums.

Documents are encoded whole and counted by length; everything else is read off the histogram.
The sums run in two steps, within blocks of lengths and over the blocks, so no task
holds more than one block, however many lengths there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm.columns import travels_with_the_job
from keyweave.llm.tokens import VOCABULARY, encoder
from keyweave.session import materialize

travels_with_the_job(__name__)

BLOCK = 4096


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): how many texts have each number of ids; NULL and empty ones have 0."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(vocabulary).encoded
        for batch in batches:
            lengths, counts = np.unique(
                np.array([len(encoded(t.as_py())) // 4 for t in batch.column(0)], dtype=np.int64),
                return_counts=True,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths), pa.array(counts.astype(np.int64))], names=["length", "n"]
            )

    found = docs.select(text).mapInArrow(of_batches, "length bigint, n bigint")
    return found.groupBy("length").agg(F.sum("n").alias("n_docs"))


def _from_here_on(histogram: DataFrame) -> DataFrame:
    """The histogram with n_from and tokens_from: documents and ids at this length or above."""
    blocks = histogram.withColumn("block", F.floor(F.col("length") / BLOCK))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    tokens = F.col("length") * F.col("n_docs")
    partial = blocks.withColumns(
        {"n_within": F.sum("n_docs").over(within), "tokens_within": F.sum(tokens).over(within)}
    )
    # Lengths are below 2^31 ids, so there are 2^19 blocks at most, one row each.
    sums = blocks.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select(
        "block",
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
    )
    return partial.join(later, "block").select(
        "length",
        "asked",
        "n_docs",
        (F.col("n_within") + F.col("n_above")).alias("n_from"),
        (F.col("tokens_within") + F.col("tokens_above")).alias("tokens_from"),
    )


def powers_of_two(longest: int) -> list[int]:
    """1, 2, 4, ... up to the first that no document exceeds."""
    return [1 << k for k in range(max(longest - 1, 0).bit_length() + 1)]


def counts_by_limit(
    docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limits: Sequence[int] | None = None
) -> DataFrame:
    """One row per occurring length and per asked limit, taken as a context limit.

    ``limits`` are the asked ones, powers of two if none are given; ``asked`` marks them.  ``n_docs`` of just that
    length, ``n_docs_within`` the limit and ``n_docs_over`` it; ``share_within``; ``percentiles``: the whole numbers p
    from 1 to 100 for which this is the smallest length that p percent of the documents keep to;
    ``truncated_tokens`` if every document is cut at the limit; ``total_tokens`` of the whole table.
    NULL and empty texts have length 0, repeated rows count each; an empty table has no row.
    """
    spark = docs.sparkSession
    histogram = materialize(length_histogram(docs, text, vocabulary), "lengths")
    whole = histogram.agg(
        F.sum("n_docs").alias("docs"),
        F.sum(F.col("length") * F.col("n_docs")).alias("tokens"),
        F.max("length").alias("longest"),
    ).first()
    asked = sorted(set(powers_of_two(whole["longest"]) if limits is None else limits)) if whole["docs"] else []
    zeros = spark.createDataFrame([(limit, 0, True) for limit in asked], "length bigint, n_docs bigint, asked boolean")
    every = histogram.withColumn("asked", F.lit(False)).union(zeros)
    every = every.groupBy("length").agg(F.sum("n_docs").alias("n_docs"), F.max("asked").alias("asked"))
    sums = _from_here_on(every)
    all_docs, total_tokens = F.lit(whole["docs"]).cast("bigint"), F.lit(whole["tokens"]).cast("bigint")
    over = F.col("n_from") - F.col("n_docs")
    tokens_over = F.col("tokens_from") - F.col("length") * F.col("n_docs")
    within = all_docs - over
    before = within - F.col("n_docs")

    def ends_here(p: Column) -> Column:
        return (p * all_docs <= 100 * within) & (p * all_docs > 100 * before)

    return sums.select(
        F.col("length").alias("context_limit"),
        "asked",
        "n_docs",
        within.alias("n_docs_within"),
        over.alias("n_docs_over"),
        (within / all_docs).alias("share_within"),
        F.filter(F.sequence(F.lit(1), F.lit(100)), ends_here).alias("percentiles"),
        (total_tokens - tokens_over + over * F.col("length")).alias("truncated_tokens"),
        total_tokens.alias("total_tokens"),
    )
