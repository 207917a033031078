"""Updates of a master table from prioritised source tables.

Three ways: append whole new rows, overwrite whole rows (dense), overwrite single cells
(sparse).  Source rows are ordered by ``order``; the source collectors reduce them to one
candidate per identity, and the candidates are joined to the master.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keyweave.functions.text import column, is_blank, same_value
from keyweave.functions.winners import first_rows, last_cell, last_rows_first_seen, position
from keyweave.operators.joins import left_join_unique
from keyweave.operators.rows import (
    COMBINED_KEY,
    ID,
    KEY_ONLY,
    Layout,
    identified_rows,
    nullable_text_of,
    source_cells,
    text_of,
    with_identity,
)
from keyweave.operators.sequence import numbered

UPDATED, FILLED, OVERWRITTEN = "_updated", "_filled", "_overwritten"
CELL_COUNTS = (UPDATED, FILLED, OVERWRITTEN)
CELL_COUNTERS = {"updated_cells": UPDATED, "filled_blank_cells": FILLED, "overwritten_cells": OVERWRITTEN}
SEEN, REPORT = "_seen", "_report"

COUNTERS = (
    "updated_cells",
    "added_rows",
    "merged_keys",
    "source_files",
    "overwritten_cells",
    "filled_blank_cells",
    "skipped_new_keys",
    "unmatched_entries",
)


# --- candidates from the sources ------------------------------------------------------

#: What is counted of the sources while their candidates are found.
SCAN_COUNTERS = ("source_files", "rows_scanned", "rows_without_identity")


class Scan:
    """Counts the rows and files of the sources in the pass that finds the candidates.

    ``values`` are there once the candidates have been written.  Files are counted by their rows; their names
    come to the driver, as those of a list of files do.
    """

    def __init__(self, sources: DataFrame, layout: Layout, row_key: str, file: str):
        self._seen = Observation("source rows")
        parts = [layout.key] if row_key == KEY_ONLY else [layout.key, layout.match]
        absent = reduce(lambda a, b: a | b, [is_blank(text_of(sources, part)) for part in parts])
        self.sources = sources.observe(
            self._seen,
            F.size(F.collect_set(F.col(file))).cast("bigint").alias("source_files"),
            F.count(F.lit(1)).alias("rows_scanned"),
            F.count_if(absent).alias("rows_without_identity"),
        )

    @property
    def values(self) -> Mapping[str, int]:
        return {name: self._seen.get[name] for name in SCAN_COUNTERS}


def append_candidates(sources: DataFrame, layout: Layout, row_key: str, order: Sequence[str]) -> DataFrame:
    """The first whole row of every identity.  With key-only rows a match text is required."""
    rows = sources
    if row_key == KEY_ONLY:
        rows = rows.filter(~is_blank(text_of(rows, layout.match)))
    cells = source_cells(rows, layout, row_key, order)
    return first_rows(cells, ID, layout.cells, order, SEEN)


def dense_candidates(sources: DataFrame, layout: Layout, row_key: str, order: Sequence[str]) -> DataFrame:
    """The last whole row of every identity, and where the identity was first seen."""
    cells = source_cells(sources, layout, row_key, order)
    return last_rows_first_seen(cells, ID, layout.cells, order, SEEN)


def sparse_candidates(sources: DataFrame, layout: Layout, order: Sequence[str], file: str) -> DataFrame:
    """Per cell the last non-blank text of every key and match; NULL cells were never touched.

    ``_report`` is the file name, key and match of the row that last touched a cell, or of
    the first row of the identity if none did.
    """
    content = layout.content(COMBINED_KEY)
    keep = list(dict.fromkeys([*order, file]))
    cells = source_cells(sources, layout, COMBINED_KEY, keep)
    place = position(order)
    touched = reduce(lambda a, b: a | b, [~is_blank(column(c)) for c in content], F.lit(False))
    origin = F.struct(
        F.element_at(F.split(F.col(file).cast("string"), "/"), -1).alias("file"),
        column(layout.key).alias("key"),
        column(layout.match).alias("match"),
    )
    return (
        cells.withColumn("_origin", origin)
        .withColumn("_touched_at", F.when(touched, place))
        .groupBy(ID)
        .agg(
            *(last_cell(c, order).alias(c) for c in content),
            F.coalesce(F.max_by("_origin", "_touched_at"), F.min_by("_origin", place)).alias(REPORT),
        )
    )


# --- the master -----------------------------------------------------------------------


def master_identities(master: DataFrame, layout: Layout, row_key: str) -> DataFrame:
    """The distinct identities of the master."""
    return identified_rows(master, layout.key, layout.match, row_key).select(ID).distinct()


def overwrite_cells(
    master: DataFrame, candidates: DataFrame, layout: Layout, row_key: str, row: str
) -> DataFrame:
    """The master with every non-NULL candidate cell written, unless it changes nothing.

    Adds the number of cells updated, of blank cells filled and of texts overwritten per
    row.  A text replaced by a blank is updated, but neither filled nor overwritten.
    """
    content = layout.content(row_key)
    news = candidates.select(ID, *(column(c).alias(f"_new_{i}") for i, c in enumerate(content)))
    joined = left_join_unique(with_identity(master, layout.key, layout.match, row_key), news, [ID], [row])
    # What happens to a cell is found once, in a step of its own, and used several times.
    states = [
        _cell_state(nullable_text_of(master, c), F.col(f"_new_{i}")).alias(f"_state_{i}") for i, c in enumerate(content)
    ]
    judged = joined.select(*map(column, master.columns), *(f"_new_{i}" for i in range(len(content))), *states)
    out = {c: nullable_text_of(master, c) for c in layout.cells}
    for i, name in enumerate(content):
        out[name] = F.when(F.col(f"_state_{i}") != KEPT, F.col(f"_new_{i}")).otherwise(out[name])

    def total(counts) -> Column:
        flags = [counts(F.col(f"_state_{i}")).cast("int") for i in range(len(content))]
        return reduce(lambda a, b: a + b, flags, F.lit(0)).cast("bigint")

    return judged.select(
        *(out[c].alias(c) if c in out else column(c) for c in master.columns),
        total(lambda state: state != KEPT).alias(UPDATED),
        total(lambda state: state == FILL).alias(FILLED),
        total(lambda state: state == REPLACE).alias(OVERWRITTEN),
    )


# What an update does to a cell.
KEPT, FILL, REPLACE, CLEAR = range(4)


def _cell_state(old: Column, new: Column) -> Column:
    return (
        F.when(new.isNull() | same_value(old, new), KEPT)
        .when(is_blank(new), CLEAR)
        .when(is_blank(old), FILL)
        .otherwise(REPLACE)
    )


def new_rows(master: DataFrame, candidates: DataFrame, layout: Layout, row_key: str) -> DataFrame:
    """The candidates whose identity the master lacks; both sides are unique per identity."""
    return candidates.join(master_identities(master, layout, row_key), ID, "left_anti")


def appended_rows(master: DataFrame, new: DataFrame, layout: Layout, row: str) -> DataFrame:
    """New rows in first-seen order, numbered on from the last master row."""
    last = master.agg(F.max(row)).first()[0]
    rows = numbered(new, [SEEN], "_new_row", start=(last or 0) + 1, label="appended")
    named = {row: F.col("_new_row").cast(master.schema[row].dataType), **{c: column(c) for c in layout.cells}}
    return rows.select(
        *(
            (named[c] if c in named else F.lit(None).cast(master.schema[c].dataType)).alias(c)
            for c in master.columns
        )
    )


def text_cells(master: DataFrame, layout: Layout) -> DataFrame:
    """The master with its cells as text."""
    cells = set(layout.cells)
    return master.select(*(nullable_text_of(master, c).alias(c) if c in cells else column(c) for c in master.columns))


# --- report and counters --------------------------------------------------------------


def unmatched_report(
    master: DataFrame, candidates: DataFrame, layout: Layout, row_key: str = COMBINED_KEY
) -> DataFrame:
    """Sparse candidates the master does not know, in (key, match, source_file) order.

    The content columns carry the 1-based position of the cell in the sheet.
    """
    position_of = {c: i for i, c in enumerate(layout.cells, start=1)}
    unknown = candidates.join(master_identities(master, layout, row_key), ID, "left_anti")
    return unknown.select(
        F.col(f"{REPORT}.key").alias("key"),
        F.col(f"{REPORT}.match").alias("match"),
        F.col(f"{REPORT}.file").alias("source_file"),
        *(column(c).alias(f"content_col_{position_of[c]}") for c in layout.content(row_key)),
    ).orderBy("key", "match", "source_file")


@dataclass(frozen=True)
class UpdateParts:
    """What the counters of one update are computed from.

    ``counted`` are sums of the cell counts of ``updated`` that are known already.  ``scan`` has counted the sources.
    ``files`` is the list of source files, if there is one; else the scan has counted them by their rows.
    """

    scan: Scan
    candidates: DataFrame
    identities: DataFrame
    updated: DataFrame | None = None
    counted: Mapping[str, int] | None = None
    added: DataFrame | None = None
    unmatched: DataFrame | None = None
    scan_without_candidates: bool = False
    files: DataFrame | None = None


def update_counters(parts: UpdateParts) -> DataFrame:
    """One row of counters.  Every part is aggregated on its own; the one-row results are summed."""

    def one_row(df: DataFrame, **values) -> DataFrame:
        names = (*COUNTERS, "_candidates")
        return df.agg(
            *(F.coalesce(values.get(n, F.lit(0)), F.lit(0)).cast("bigint").alias(n) for n in names)
        )

    count = F.count(F.lit(1))
    if parts.files is not None:
        rows = [one_row(parts.files, source_files=count)]
        rows.append(one_row(parts.identities, merged_keys=count))
    else:
        seen = F.lit(parts.scan.values["source_files"])
        rows = [one_row(parts.identities, merged_keys=count, source_files=seen)]
    if not parts.scan_without_candidates:
        rows.append(one_row(parts.candidates, _candidates=count))
    if parts.counted is not None:
        cells = {name: F.lit(parts.counted[c]) for name, c in CELL_COUNTERS.items()}
        rows.append(one_row(parts.candidates, **cells))
    elif parts.updated is not None:
        cells = {name: F.sum(c) for name, c in CELL_COUNTERS.items()}
        rows.append(one_row(parts.updated, **cells))
    if parts.added is not None:
        rows.append(one_row(parts.added, added_rows=count, merged_keys=count))
    if parts.unmatched is not None:
        rows.append(one_row(parts.unmatched, skipped_new_keys=count, unmatched_entries=count))
    totals = reduce(DataFrame.unionByName, rows).agg(*(F.sum(n).alias(n) for n in (*COUNTERS, "_candidates")))
    merged = F.col("merged_keys")
    if not parts.scan_without_candidates:
        # Without a candidate the master is not looked at.
        merged = F.when(F.col("_candidates") > 0, merged).otherwise(F.lit(0))
    return totals.withColumn("merged_keys", merged).drop("_candidates")
