"""Columns of the tables to reconcile, and the identity of their rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import (
    SEPARATOR,
    cell_text,
    column,
    combined_identity,
    is_blank,
    key_identity,
    strip,
    text_or_empty,
)

ID = "_id"

COMBINED_KEY = "combined_key"
KEY_ONLY = "key_only"


@dataclass(frozen=True)
class SyncColumns:
    """Where one side of a sync keeps its key, its match text and its values."""

    key: str
    match: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """The cells of a master table in sheet order; key and match are among them."""

    key: str
    match: str
    cells: tuple[str, ...]

    def content(self, row_key: str) -> list[str]:
        """The cells an update may write: all but the identity."""
        identity = {self.key} if row_key == KEY_ONLY else {self.key, self.match}
        return [c for c in self.cells if c not in identity]


def resolve_layout(columns: Sequence[str], key: str, match: str, last: str | None = None) -> Layout:
    """The cells of a table up to ``last``, which must not lie before key or match."""
    columns = list(columns)
    for name in (key, match, *([last] if last else [])):
        if name not in columns:
            raise ValueError(f"no such column: {name}")
    end = columns.index(last) if last else len(columns) - 1
    if end < max(columns.index(key), columns.index(match)):
        raise ValueError("the last update column must not lie before the key or match column")
    return Layout(key, match, tuple(columns[: end + 1]))


def columns_at(df: DataFrame, first: int, count: int = 1, ignore: Sequence[str] = ()) -> list[str]:
    """Names of ``count`` columns from the 1-based position ``first``, service columns left out."""
    if first < 1 or count < 1:
        raise ValueError("column positions and counts start at 1")
    names = [c for c in df.columns if c not in ignore]
    return names[first - 1 : first - 1 + count]


def text_of(df: DataFrame, name: str):
    """Text of a column of ``df``, empty cells as the empty text."""
    return text_or_empty(column(name), df.schema[name].dataType)


def nullable_text_of(df: DataFrame, name: str):
    """Text of a column of ``df``, empty cells as NULL."""
    return cell_text(column(name), df.schema[name].dataType)


def with_identity(df: DataFrame, key: str, match: str | None, row_key: str = COMBINED_KEY) -> DataFrame:
    """All rows with their identity, NULL where there is none.

    The parts are stripped once, in a step of their own.
    """
    _check(row_key)
    if row_key == KEY_ONLY:
        stripped = df.withColumn("_key_part", strip(text_of(df, key)))
        return stripped.withColumn(ID, key_identity(F.col("_key_part"))).drop("_key_part")
    stripped = df.withColumns({"_key_part": strip(text_of(df, key)), "_match_part": strip(text_of(df, match))})
    identity = combined_identity(F.col("_key_part"), F.col("_match_part"))
    return stripped.withColumn(ID, identity).drop("_key_part", "_match_part")


def identified_rows(df: DataFrame, key: str, match: str | None, row_key: str = COMBINED_KEY) -> DataFrame:
    """The rows that have an identity.

    They are chosen by a test of the parts that stops at the first visible character, so
    only the rows that stay are stripped.
    """
    _check(row_key)
    parts = [key] if row_key == KEY_ONLY else [key, match]
    rows = df
    for part in parts:
        rows = rows.filter(~is_blank(text_of(df, part)))
    texts = [strip(text_of(df, part)) for part in parts]
    return rows.withColumn(ID, texts[0] if row_key == KEY_ONLY else F.concat(texts[0], F.lit(SEPARATOR), texts[1]))


def source_cells(sources: DataFrame, layout: Layout, row_key: str, keep: Sequence[str]) -> DataFrame:
    """Update rows as text: stripped identity parts, content as it is; rows need an identity."""
    content = set(layout.content(row_key))
    present = set(sources.columns)
    cells = []
    for name in layout.cells:
        text = text_of(sources, name) if name in present else F.lit("")
        cells.append((text if name in content else strip(text)).alias(name))
    return identified_rows(sources, layout.key, layout.match, row_key).select(*keep, ID, *cells)


def _check(row_key: str) -> None:
    if row_key not in (COMBINED_KEY, KEY_ONLY):
        raise ValueError(f"row_key_policy has no value {row_key!r}")
