"""Forward and reverse sync between one master table and many target tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import column, is_blank
from keyweave.functions.winners import last_rows, position
from keyweave.operators.joins import left_join_unique
from keyweave.operators.rows import (
    ID,
    SyncColumns,
    identified_rows,
    nullable_text_of,
    text_of,
    with_identity,
)

WRITTEN = "cells_written"


def master_index(master: DataFrame, columns: SyncColumns, order: Sequence[str]) -> DataFrame:
    """One row per identity with its values; the last master row wins, blank or not.

    A value column the master does not have is read as empty text.
    """
    present = set(master.columns)
    values = [
        (text_of(master, name) if name in present else F.lit("")).alias(f"_new_{i}")
        for i, name in enumerate(columns.values)
    ]
    rows = identified_rows(master, columns.key, columns.match).select(ID, *order, *values)
    return last_rows(rows, ID, [f"_new_{i}" for i in range(len(values))], order)


def _write_cells(
    rows: DataFrame,
    index: DataFrame,
    columns: SyncColumns,
    place: Sequence[str],
    fill_blank_only: bool,
    allow_blank_write: bool,
    only: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Join the index to the rows and write each cell the rules allow; every write counts."""
    joined = left_join_unique(with_identity(rows, columns.key, columns.match), index, [ID], place)
    writes = []
    for i, name in enumerate(columns.values):
        new, old = F.col(f"_new_{i}"), nullable_text_of(rows, name)
        write = new.isNotNull()
        if only:
            write = write & only[name]
        if not allow_blank_write:
            write = write & ~is_blank(new)
        if fill_blank_only:
            write = write & is_blank(old)
        writes.append(write.alias(f"_write_{i}"))
    # Whether a cell is written is found once, in a step of its own, and used twice.
    judged = joined.select(*map(column, rows.columns), *(f"_new_{i}" for i in range(len(writes))), *writes)
    out = {
        name: F.when(F.col(f"_write_{i}"), F.col(f"_new_{i}")).otherwise(nullable_text_of(rows, name))
        for i, name in enumerate(columns.values)
    }
    written = reduce(lambda a, b: a + b, [F.col(f"_write_{i}").cast("int") for i in range(len(writes))])
    return judged.select(
        *(out[c].alias(c) if c in out else column(c) for c in rows.columns),
        written.cast("bigint").alias(WRITTEN),
    )


def sync_multi(
    targets: DataFrame,
    target: SyncColumns,
    master: DataFrame,
    source: SyncColumns,
    *,
    target_place: Sequence[str],
    master_order: Sequence[str],
    fill_blank_only: bool = False,
    allow_blank_write: bool = False,
    only: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Master values into the target rows of the same identity, cell by cell.

    Returns the whole target table with ``cells_written`` per row.  ``target_place`` names
    the columns that tell target rows apart (file and row).  ``only`` restricts the rows in
    which a value column is written.
    """
    if len(target.values) != len(source.values) or not target.values:
        raise ValueError("target and master need the same number of value columns, at least one")
    index = master_index(master, source, master_order)
    return _write_cells(targets, index, target, target_place, fill_blank_only, allow_blank_write, only)


def sync_single(
    targets: DataFrame,
    target: SyncColumns,
    master: DataFrame,
    source: SyncColumns,
    **options,
) -> DataFrame:
    """``sync_multi`` for exactly one value column."""
    if len(target.values) != 1:
        raise ValueError("a single-column sync writes exactly one column")
    return sync_multi(targets, target, master, source, **options)


def target_winners(
    targets: DataFrame, columns: SyncColumns, order: Sequence[str], allow_blank_write: bool = False
) -> DataFrame:
    """One value per identity over all target files; the last one wins.

    Blank values are left out *before* the winner is chosen unless they may be written.
    """
    rows = identified_rows(targets, columns.key, columns.match).select(
        ID, *order, text_of(targets, columns.values[0]).alias("_new_0")
    )
    if not allow_blank_write:
        rows = rows.filter(~is_blank(F.col("_new_0")))
    return rows.groupBy(ID).agg(F.max_by("_new_0", position(order)).alias("_new_0"))


def sync_reverse(
    master: DataFrame,
    source: SyncColumns,
    targets: DataFrame,
    target: SyncColumns,
    *,
    master_place: Sequence[str],
    target_order: Sequence[str],
    fill_blank_only: bool = False,
    allow_blank_write: bool = False,
) -> DataFrame:
    """Target values into all master rows of the same identity; ``cells_written`` per row."""
    if len(target.values) != 1 or len(source.values) != 1:
        raise ValueError("a reverse sync moves exactly one column")
    winners = target_winners(targets, target, target_order, allow_blank_write)
    # A winner may be written as it is: what must not be written was left out above.
    return _write_cells(master, winners, source, master_place, fill_blank_only, True)


def written_by_file(result: DataFrame, file: str) -> DataFrame:
    """Cells written per file; files without a write stay in the list with 0."""
    return result.groupBy(file).agg(F.sum(WRITTEN).alias(WRITTEN))


def written_total(result: DataFrame) -> DataFrame:
    return result.agg(F.coalesce(F.sum(WRITTEN), F.lit(0)).cast("bigint").alias(WRITTEN))
