"""Split of a term into body and suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import is_blank, strip

HALVES = ("body", "suffix", "delimiter")


def with_halves(rows: DataFrame, text: str, delimiters: Sequence[str]) -> DataFrame:
    """``rows`` with ``body``, ``suffix`` and ``delimiter`` at the earliest delimiter, or NULLs.

    At the same position the delimiter listed first is taken.  The suffix starts with the
    delimiter and keeps its trailing text; nothing is split if either side is blank.  Each
    step is a projection of its own, so that no search is repeated.
    """
    kept = rows.columns
    places = [f"_at_{i}" for i in range(len(delimiters))]
    found = rows.select(*kept, *(F.instr(text, d).alias(p) for p, d in zip(places, delimiters)))
    earliest = F.array_min(F.array(*(F.when(F.col(p) > 0, F.col(p)) for p in places)))
    found = found.select(*kept, *places, earliest.alias("_at"))
    delimiter = F.lit(None).cast("string")
    for p, d in reversed(list(zip(places, delimiters))):
        delimiter = F.when(F.col(p) == F.col("_at"), d).otherwise(delimiter)
    found = found.select(*kept, "_at", delimiter.alias("_delimiter"))
    found = found.select(
        *kept,
        "_delimiter",
        strip(F.substring(text, F.lit(1), F.col("_at") - 1)).alias("_body"),
        F.substring(text, F.col("_at") + F.length("_delimiter"), F.length(text)).alias("_payload"),
    )
    split = F.col("_delimiter").isNotNull() & (F.col("_body") != "") & ~is_blank(F.col("_payload"))
    values = (F.col("_body"), F.concat("_delimiter", "_payload"), F.col("_delimiter"))
    return found.select(*kept, *(F.when(split, v).alias(name) for name, v in zip(HALVES, values)))
