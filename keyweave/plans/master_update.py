"""The master update suite: policies choose the way a master takes over its sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators import update as U
from keyweave.operators.rows import COMBINED_KEY, KEY_ONLY, Layout
from keyweave.session import materialize

FILL_BLANK_ONLY = "fill_blank_only"
OVERWRITE_NON_BLANK = "overwrite_non_blank"
ALLOW_NEW_KEY = "allow_new_key"
EXISTING_KEY_ONLY = "existing_key_only"
LAST_PROCESSED = "last_processed"

_ALLOWED = {
    "cell_write_policy": (FILL_BLANK_ONLY, OVERWRITE_NON_BLANK),
    "key_admission_policy": (ALLOW_NEW_KEY, EXISTING_KEY_ONLY),
    "priority_winner_policy": (LAST_PROCESSED,),
    "row_key_policy": (COMBINED_KEY, KEY_ONLY),
}


@dataclass(frozen=True)
class UpdatePolicies:
    cell_write_policy: str = FILL_BLANK_ONLY
    key_admission_policy: str = ALLOW_NEW_KEY
    priority_winner_policy: str = LAST_PROCESSED
    row_key_policy: str = COMBINED_KEY

    def __post_init__(self):
        for name, allowed in _ALLOWED.items():
            value = getattr(self, name)
            if value not in allowed:
                raise ValueError(f"{name} has no value {value!r}")


@dataclass(frozen=True)
class MasterUpdate:
    """The new master, the counters of the change, and the report of unknown identities.

    ``rows`` is the master with the cell counts of each row, if cells were updated.
    """

    rows: DataFrame
    parts: U.UpdateParts
    unmatched: DataFrame | None = None

    @property
    def cell_counts(self) -> tuple[str, ...]:
        return U.CELL_COUNTS if self.parts.updated is not None else ()

    @property
    def master(self) -> DataFrame:
        return self.rows.drop(*self.cell_counts)

    @property
    def counters(self) -> DataFrame:
        return U.update_counters(self.parts)

    @property
    def scan_counters(self) -> DataFrame:
        """Files and rows of the sources, and rows without identity, as one row."""
        values = self.parts.scan.values
        spark = self.rows.sparkSession
        return spark.range(1).select(*(F.lit(values[n]).cast("bigint").alias(n) for n in U.SCAN_COUNTERS))

    def counters_with(self, counted: Mapping[str, int]) -> DataFrame:
        """The counters, with cell counts a write of ``rows`` has summed up."""
        return U.update_counters(replace(self.parts, counted=counted))


def _with_zero_counts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(0).cast("bigint") for c in U.CELL_COUNTS})


def merge_masters(
    master: DataFrame,
    sources: DataFrame,
    layout: Layout,
    *,
    row: str,
    order: Sequence[str],
    file: str,
    row_key: str = COMBINED_KEY,
) -> MasterUpdate:
    """Append the first row of every new identity; existing rows stay as they are."""
    scan = U.Scan(sources, layout, row_key, file)
    candidates = materialize(U.append_candidates(scan.sources, layout, row_key, order), "append-candidates")
    added = U.appended_rows(master, U.new_rows(master, candidates, layout, row_key), layout, row)
    identities = U.master_identities(master, layout, row_key)
    parts = U.UpdateParts(scan, candidates, identities, added=added, scan_without_candidates=True)
    return MasterUpdate(U.text_cells(master, layout).unionByName(added), parts)


def update_master(
    master: DataFrame, sources: DataFrame, layout: Layout, *, row: str, order: Sequence[str], file: str
) -> MasterUpdate:
    """Dense: the last source row replaces all content of its key; new keys are appended."""
    scan = U.Scan(sources, layout, KEY_ONLY, file)
    candidates = materialize(U.dense_candidates(scan.sources, layout, KEY_ONLY, order), "dense-candidates")
    updated = U.overwrite_cells(master, candidates, layout, KEY_ONLY, row)
    added = U.appended_rows(master, U.new_rows(master, candidates, layout, KEY_ONLY), layout, row)
    identities = U.master_identities(master, layout, KEY_ONLY)
    parts = U.UpdateParts(scan, candidates, identities, updated=updated, added=added)
    return MasterUpdate(updated.unionByName(_with_zero_counts(added)), parts)


def update_content(
    master: DataFrame, sources: DataFrame, layout: Layout, *, row: str, order: Sequence[str], file: str
) -> MasterUpdate:
    """Sparse: the last non-blank text of each cell, for identities the master has."""
    scan = U.Scan(sources, layout, COMBINED_KEY, file)
    candidates = materialize(U.sparse_candidates(scan.sources, layout, order, file), "sparse-candidates")
    updated = U.overwrite_cells(master, candidates, layout, COMBINED_KEY, row)
    unmatched = U.unmatched_report(master, candidates, layout, COMBINED_KEY)
    identities = U.master_identities(master, layout, COMBINED_KEY)
    parts = U.UpdateParts(scan, candidates, identities, updated=updated, unmatched=unmatched)
    return MasterUpdate(updated, parts, unmatched)


def update_master_table(
    master: DataFrame,
    sources: DataFrame,
    layout: Layout,
    policies: UpdatePolicies = UpdatePolicies(),
    *,
    row: str,
    order: Sequence[str],
    file: str,
    files: DataFrame | None = None,
) -> MasterUpdate:
    """Run the update the policies name.

    Overwriting with new keys always identifies rows by key; overwriting existing keys only
    always identifies them by key and match.  ``files`` is the list of the source files, which
    the counters then count, those without rows included.
    """

    def counted(update: MasterUpdate) -> MasterUpdate:
        return replace(update, parts=replace(update.parts, files=files))

    chosen = (policies.cell_write_policy, policies.key_admission_policy)
    where = {"row": row, "order": order, "file": file}
    if chosen == (FILL_BLANK_ONLY, ALLOW_NEW_KEY):
        return counted(merge_masters(master, sources, layout, row_key=policies.row_key_policy, **where))
    if chosen == (OVERWRITE_NON_BLANK, ALLOW_NEW_KEY):
        return counted(update_master(master, sources, layout, **where))
    if chosen == (OVERWRITE_NON_BLANK, EXISTING_KEY_ONLY):
        return counted(update_content(master, sources, layout, **where))
    raise ValueError(f"no update goes with the policies {' and '.join(chosen)}")


def source_then_translation(
    master: DataFrame,
    source_updates: DataFrame,
    translation_updates: DataFrame,
    layout: Layout,
    *,
    row: str,
    order: Sequence[str],
    file: str,
) -> tuple[MasterUpdate, MasterUpdate]:
    """A dense update, then a sparse update of its result.

    The first result is written before the second stage reads it, and it stays whatever the
    second stage does.
    """
    first = update_master(master, source_updates, layout, row=row, order=order, file=file)
    stored = materialize(first.rows, "source-stage")
    stage = replace(first, rows=stored, parts=replace(first.parts, updated=stored))
    second = update_content(stage.master, translation_updates, layout, row=row, order=order, file=file)
    return stage, second
