"""Joins of a large table with a table that has one row per identity.

An identity may hold a large share of the large side.  The joins below therefore ask for a
shuffle of both sides on (hash, identity) instead of reusing the partitioning an aggregate
left behind on the identity alone: adaptive execution splits an oversized partition only
where a shuffle feeds the join directly on both sides.  The small side is replicated to the
splits, and all rows are kept.  Whether the unique side is broadcast instead is left to
``spark.sql.autoBroadcastJoinThreshold``, which checks its size.

Rows without identity never match.  In an outer join they get the hash of their own place,
so they spread over all partitions instead of meeting in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HASH = "_join_hash"


def _hashed(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.withColumn(_HASH, F.xxhash64(*on))


def left_join_unique(
    rows: DataFrame, unique: DataFrame, on: Sequence[str], spread: Sequence[str]
) -> DataFrame:
    """``rows`` left join ``unique``; ``spread`` names the columns that place a row."""
    missing = F.lit(False)
    for name in on:
        missing = missing | F.col(name).isNull()
    left = rows.withColumn(_HASH, F.when(missing, F.xxhash64(*spread)).otherwise(F.xxhash64(*on)))
    return left.join(_hashed(unique, on), [_HASH, *on], "left").drop(_HASH)


def inner_join_unique(rows: DataFrame, unique: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``rows`` that have a partner in ``unique``, with its columns."""
    return _hashed(rows, on).join(_hashed(unique, on), [_HASH, *on], "inner").drop(_HASH)


def rows_absent_from(rows: DataFrame, unique: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``rows`` that have no partner in ``unique``."""
    return _hashed(rows, on).join(_hashed(unique, on), [_HASH, *on], "left_anti").drop(_HASH)
