"""Cell-by-cell comparison of two tables.

Rows are compared in blocks of consecutive numbers first: every block of both tables has a digest of its cells, summed
up in one pass that shuffles a row per block.  Only rows of blocks whose digests differ are paired and
compared by cell, so tables that are mostly equal cost little more than reading them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.operators.rows import nullable_text_of
from keyweave.session import materialize

BLOCK_ROWS = 4096
#: Differing blocks up to so many are broadcast; with more of them all rows are compared.
MOST_BROADCAST = 1_000_000


def _cells(df: DataFrame, row: str, service: Sequence[str], side: str) -> tuple[DataFrame, list[Column]]:
    """The row number and the texts of all cells of a table, as ``<side>1``, ``<side>2``, ..."""
    names = [c for c in df.columns if c != row and c not in service]
    texts = [nullable_text_of(df, c).alias(f"{side}{i}") for i, c in enumerate(names, start=1)]
    return df.select(F.col(row).cast("bigint").alias("row"), *texts), [F.col(f"{side}{i}") for i in range(1, len(names) + 1)]


def _block(block_rows: int) -> Column:
    return F.floor(F.col("row") / block_rows)


def _digests(rows: DataFrame, cells: Sequence[Column], block_rows: int, side: str) -> DataFrame:
    """(block, digest): the sums of two hashes of every row, over its number and the cells that are not empty."""

    def of_row(seed: int) -> Column:
        # An empty cell is left out, so each of the others says which one it is.
        marked = [F.when(c.isNotNull(), F.struct(F.lit(i), c)) for i, c in enumerate(cells, start=1)]
        filled = F.lit(False)
        for c in cells:
            filled = filled | c.isNotNull()
        hashed = F.xxhash64(F.lit(seed), "row", *marked).cast("decimal(38,0)")
        return F.sum(F.when(filled, hashed))

    sums = F.struct(F.coalesce(of_row(1), F.lit(0)).alias("one"), F.coalesce(of_row(2), F.lit(0)).alias("two"))
    return rows.groupBy(_block(block_rows).alias("block")).agg(sums.alias(side))


def differing_blocks(
    expected: DataFrame, actual: DataFrame, *, row: str, service: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The blocks of row numbers that have a differing cell; a block that one table lacks counts as empty."""
    sides = [
        _digests(*_cells(df, row, service, side), block_rows, side) for df, side in ((expected, "e"), (actual, "a"))
    ]
    none = F.struct(*(F.lit(0).cast("decimal(38,0)").alias(n) for n in ("one", "two")))
    both = sides[0].join(sides[1], "block", "full_outer")
    e, a = (F.coalesce(side, none) for side in ("e", "a"))
    return both.where((e["one"] != a["one"]) | (e["two"] != a["two"])).select("block")


def diff_cells(
    expected: DataFrame, actual: DataFrame, *, row: str, service: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All differing cells as (row, col, expected, actual); ``col`` is the 1-based position.

    Rows are paired by number, which must be unique per table, and compared as a whole: one
    shuffle of the rows in differing blocks, whatever their width.  A missing row or column counts as empty.
    """
    found = differing_blocks(expected, actual, row=row, service=service, block_rows=block_rows)
    blocks = materialize(found, "differing-blocks")
    left, left_cells = _cells(expected, row, service, "e")
    right, right_cells = _cells(actual, row, service, "a")
    none = F.lit(None).cast("string")
    differing = []
    for i in range(1, max(len(left_cells), len(right_cells)) + 1):
        e = F.col(f"e{i}") if i <= len(left_cells) else none
        a = F.col(f"a{i}") if i <= len(right_cells) else none
        differing.append(
            F.when(
                ~e.eqNullSafe(a),
                F.struct(F.lit(i).cast("bigint").alias("col"), e.alias("expected"), a.alias("actual")),
            )
        )

    few = blocks.count() <= MOST_BROADCAST

    def of_blocks(rows: DataFrame) -> DataFrame:
        if not few:
            return rows
        return rows.withColumn("block", _block(block_rows)).join(F.broadcast(blocks), "block", "left_semi").drop("block")

    pairs = of_blocks(left).join(of_blocks(right), "row", "full_outer")
    return pairs.select("row", F.inline(F.array_compact(F.array(*differing))))


def diff_tables(
    expected: DataFrame,
    actual: DataFrame,
    *,
    row: str,
    service: Sequence[str] = (),
    max_diff_samples: int | None = None,
) -> DataFrame:
    """The differing cells in row-major order, the first ones only if a number is given; none: the tables are equal."""
    found = diff_cells(expected, actual, row=row, service=service).orderBy("row", "col")
    return found if max_diff_samples is None else found.limit(max_diff_samples)
