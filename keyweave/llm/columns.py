"""Small column helpers that the operators of this package share."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word rules: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` reads it.

    A lambda variable holds the value, so an inner lambda that reads it for each item of an
    array does not compute it anew.
    """
    return F.transform(F.array(value), body).getItem(0)


def space_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a NULL, empty or blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    )


def whole_quotient(value: Column, by: Column) -> Column:
    """``value`` divided by ``by``, both whole, not negative and below 2 to the 53, without the rest."""
    return ((value - value % by) / by).cast("bigint")


def bigint_array(values: list[int]) -> Column:
    """A constant array; the optimizer folds the split text into a literal once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def travels_with_the_job(module: str) -> None:
    """Pickle the functions of a module by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
