"""Consecutive numbers over a whole ordered table, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.session import materialize

_SLOT = "_slot"
# monotonically_increasing_id() is the partition number in the upper bits and the place of
# the row within its partition in the lower 33 bits.
_ROW_BITS = 33


def numbered(
    rows: DataFrame,
    order: Sequence[str],
    name: str,
    *,
    start: int = 1,
    label: str = "numbered",
) -> DataFrame:
    """``rows`` with ``name`` = start, start+1, ... in the order of the given columns.

    The table is sorted by range, and every row is written with its place within its
    partition; only the row count of each partition comes back to the driver, and the
    counts are summed to the offset of each partition.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(placed.withColumn(_SLOT, F.monotonically_increasing_id()), label)

    part = F.shiftright(F.col(_SLOT), _ROW_BITS).cast("int")
    sizes = dict(stored.groupBy(part.alias("part")).count().collect())
    counts = [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]
    offsets = list(accumulate(counts, initial=start))[:-1]
    offset = F.lit(offsets[0]) if len(offsets) == 1 else F.element_at(F.lit(offsets), part + 1)
    within = F.col(_SLOT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return stored.withColumn(name, (offset + within).cast("bigint")).drop(_SLOT)
