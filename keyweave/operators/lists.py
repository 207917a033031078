"""Sorted lists of many items joined to the text of one cell, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators.joins import left_join_unique
from keyweave.operators.sequence import numbered

ITEMS_PER_CELL = 50_000

COUNT, LIST, PART = "items_count", "items_list", "items_part"


def list_cells(
    pairs: DataFrame, by: Sequence[str], item: str, *, items_per_cell: int = ITEMS_PER_CELL
) -> DataFrame:
    """``;``-joined sorted items per group, with their count, in pieces of ``items_per_cell``.

    ``pairs`` holds each (group, item) once.  The pairs are ranked, and every run of
    ``items_per_cell`` items of a group is one row, numbered by ``items_part`` from 0: the pieces of
    a group, in order, are its whole list, and no task gathers more than one piece.
    """
    by = list(by)
    ranked = numbered(pairs.select(*by, item), [*by, item], "_rank", label="list-ranks")
    groups = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias(COUNT))
    placed = left_join_unique(ranked, groups, by, [*by, item])
    part = F.floor((F.col("_rank") - F.col("_first")) / items_per_cell).cast("bigint")
    joined = F.array_join(F.array_sort(F.collect_list(item)), ";").alias(LIST)
    return placed.groupBy(*by, COUNT, part.alias(PART)).agg(joined)
