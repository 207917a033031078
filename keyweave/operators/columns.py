"""Edits of one column in every table of a folder.  Positions are 1-based."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import column
from keyweave.operators.rows import columns_at

INSERTED = "Translation"


def _cells(df: DataFrame, service: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in service]


def clear_column(df: DataFrame, number: int, *, service: Sequence[str] = ()) -> DataFrame:
    """Empty every data cell of the column; a position past the last column changes nothing."""
    names = columns_at(df, number, ignore=service)
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in names})


def insert_column(df: DataFrame, number: int, *, service: Sequence[str] = (), header: str = INSERTED) -> DataFrame:
    """Insert an empty text column before the column at this position.

    Past the last column, the gap is filled with empty columns.
    """
    if number < 1:
        raise ValueError("column positions start at 1")
    cells = _cells(df, service)
    empty = F.lit(None).cast("string")
    gap = [empty.alias(f"col_{i}") for i in range(len(cells) + 1, number)]
    return df.select(
        *(column(c) for c in df.columns if c in service),
        *map(column, cells[: number - 1]),
        *gap,
        empty.alias(header),
        *map(column, cells[number - 1 :]),
    )


def delete_column(df: DataFrame, number: int, *, service: Sequence[str] = ()) -> DataFrame:
    return df.drop(*columns_at(df, number, ignore=service))
