"""Which row, or which cell, wins when several rows have one identity.

The order of rows is always explicit: a list of columns, compared from left to right.
The rows given must have an identity.  Each function is one aggregate, so rows of a frequent identity are reduced before the
shuffle and none of them is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import column, is_blank


def position(order: Sequence[str]) -> Column:
    """The place of a row as one comparable value."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def last_rows(rows: DataFrame, identity: str, cells: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last whole row of every identity, blank cells included."""
    return (
        rows.groupBy(identity)
        .agg(F.max_by(F.struct(*map(column, cells)), position(order)).alias("_cells"))
        .select(identity, "_cells.*")
    )


def last_rows_first_seen(
    rows: DataFrame, identity: str, cells: Sequence[str], order: Sequence[str], seen: str = "_seen"
) -> DataFrame:
    """As ``last_rows``, with the place where the identity was first seen."""
    return (
        rows.groupBy(identity)
        .agg(
            F.max_by(F.struct(*map(column, cells)), position(order)).alias("_cells"),
            F.min(position(order)).alias(seen),
        )
        .select(identity, "_cells.*", seen)
    )


def first_rows(
    rows: DataFrame, identity: str, cells: Sequence[str], order: Sequence[str], seen: str = "_seen"
) -> DataFrame:
    """The first whole row of every identity and its place."""
    return (
        rows.groupBy(identity)
        .agg(
            F.min_by(F.struct(*map(column, cells)), position(order)).alias("_cells"),
            F.min(position(order)).alias(seen),
        )
        .select(identity, "_cells.*", seen)
    )


def last_cell(cell: str, order: Sequence[str]) -> Column:
    """Aggregate: the last non-blank value; NULL if the cell was never touched."""
    return F.max_by(column(cell), F.when(~is_blank(column(cell)), position(order)))


def first_cell(cell: str, order: Sequence[str]) -> Column:
    """Aggregate: the first non-blank value; NULL if there is none."""
    return F.min_by(column(cell), F.when(~is_blank(column(cell)), position(order)))


def first_cells(rows: DataFrame, identity: str, cells: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per cell, the first non-blank value of every identity."""
    return (
        rows.groupBy(identity)
        .agg(*(first_cell(c, order).alias(c) for c in cells))
    )
