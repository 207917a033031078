"""Terminology mining from cells to the four reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators import relations as R
from keyweave.operators import terms as T
from keyweave.operators.candidates import candidates, version_counts, with_candidate_ids, with_cell_text
from keyweave.operators.lists import ITEMS_PER_CELL, list_cells
from keyweave.plans.term_config import TermConfig
from keyweave.session import materialize


SUMMARY = (
    "files_total",
    "files_succeeded",
    "files_failed",
    "rows_scanned",
    "rows_skipped_by_version",
    "candidates_count",
    "normalized_count",
    "body_terms_count",
    "suffix_terms_count",
    "terms_count",
    "relations_count",
    "review_count",
)


def run_summary(
    cells: DataFrame,
    config: TermConfig,
    found: DataFrame,
    known: DataFrame,
    relations: DataFrame,
    review: DataFrame,
    *,
    path: str,
    files_failed: int = 0,
    files_read: int | None = None,
) -> DataFrame:
    """One row of counts.  Without ``files_read``, files are counted by their rows."""
    count = F.count(F.lit(1))
    version = next((c for c in cells.columns if c.lower() == "version"), "version")
    read = cells.agg(F.count_distinct(path).alias("n")) if files_read is None else None

    def one_row(df: DataFrame, **values) -> DataFrame:
        return df.agg(*(F.coalesce(values.get(n, F.lit(0)), F.lit(0)).cast("bigint").alias(n) for n in SUMMARY))

    is_body = (F.col("term_type") == T.BODY).cast("bigint")
    rows = [
        one_row(
            version_counts(cells, config.versions, version),
            rows_scanned=F.sum("rows_scanned"),
            rows_skipped_by_version=F.sum("rows_skipped_by_version"),
            files_total=F.lit(files_failed + (files_read or 0)),
            files_succeeded=F.lit(files_read or 0),
            files_failed=F.lit(files_failed),
        ),
        one_row(found, candidates_count=count),
        one_row(T.normalized_candidates(found, config.normalization), normalized_count=count),
        one_row(known, body_terms_count=F.sum(is_body), suffix_terms_count=F.sum(1 - is_body), terms_count=count),
        one_row(relations, relations_count=count),
        one_row(review, review_count=count),
    ]
    if read is not None:
        rows.append(one_row(read, files_total=F.sum("n"), files_succeeded=F.sum("n")))
    return reduce(DataFrame.unionByName, rows).agg(*(F.sum(n).alias(n) for n in SUMMARY))


class MinedTerms:
    """The reports of one terminology run.

    A list of more than ``items_per_cell`` items goes on in further rows of the same report,
    numbered by ``items_part``.
    Candidates, terms and affix pairs are stored the first time a report needs them, and
    every report reads the columns it needs from these tables.
    """

    def __init__(
        self,
        cells: DataFrame,
        config: TermConfig,
        *,
        path: str,
        row: str,
        file: str | None = None,
        sheet: str | None = None,
        files_failed: int = 0,
        files_read: int | None = None,
        items_per_cell: int = ITEMS_PER_CELL,
    ):
        self._cells, self._config = cells, config
        self._place = {"path": path, "row": row, "file": file, "sheet": sheet}
        self._files_failed, self._files_read = files_failed, files_read
        self._items_per_cell = items_per_cell
        # Built at once, so that a missing column is reported before anything runs.
        self._extracted = candidates(cells, config.rules, **self._place, versions=config.versions)

    @cached_property
    def _found(self) -> DataFrame:
        return materialize(self._extracted, "candidates")

    @cached_property
    def candidates(self) -> DataFrame:
        """The candidates in order, with their ids."""
        return with_candidate_ids(self._found)

    @cached_property
    def _parts(self) -> DataFrame:
        return materialize(T.components(self._found, self._config), "components")

    @cached_property
    def state(self) -> DataFrame:
        """What is kept of a run to add files later: see ``term_state``.  Terms and their files come from it."""
        return materialize(T.term_state(self._parts), "term-state")

    @cached_property
    def terms(self) -> DataFrame:
        return T.terms(self.state, self._config.thresholds)

    @cached_property
    def term_files(self) -> DataFrame:
        """(term_type, dedup_key, file): each file of each term."""
        return T.term_files(self.state)

    @cached_property
    def term_keys(self) -> DataFrame:
        """(term_type, dedup_key, key_value): each key of each term."""
        return T.term_keys(self._parts)

    @cached_property
    def related_terms(self) -> DataFrame:
        """(role, anchor_key, anchor_term, related_term): each affix relation."""
        return R.related_terms(self._pairs)

    @cached_property
    def _files(self) -> DataFrame:
        return list_cells(self.term_files, T.TERM, "file", items_per_cell=self._items_per_cell)

    @cached_property
    def _keys(self) -> DataFrame:
        return list_cells(self.term_keys, T.TERM, "key_value", items_per_cell=self._items_per_cell)

    @cached_property
    def _pairs(self) -> DataFrame:
        return R.affix_pairs(self._found, self.terms, self._config)

    @cached_property
    def terms_summary(self) -> DataFrame:
        return T.terms_summary(self.terms, self._files, self._keys)

    @cached_property
    def relations_summary(self) -> DataFrame:
        return R.relations_summary(self.cross_file_terms, self.affix_groups)

    @cached_property
    def cross_file_terms(self) -> DataFrame:
        return R.cross_file_terms(self.terms, self._files)

    @cached_property
    def affix_groups(self) -> DataFrame:
        return R.affix_groups(
            self._pairs, self._config.affix_delimiters, items_per_cell=self._items_per_cell
        )

    @cached_property
    def review(self) -> DataFrame:
        return T.review_items(self.terms)

    @cached_property
    def details(self) -> DataFrame:
        """Every occurrence of every term, with the cell it was found in."""
        occurrences = T.term_occurrences(T.components(self.candidates, self._config), self.terms)
        with_text = with_cell_text(occurrences, self._cells, self._config.rules, **self._place)
        return with_text.select(*T.DETAIL_COLUMNS)

    @cached_property
    def summary(self) -> DataFrame:
        return run_summary(
            self._cells,
            self._config,
            self._found,
            self.terms,
            R.relation_keys(self.terms, self._pairs),
            self.review,
            path=self._place["path"],
            files_failed=self._files_failed,
            files_read=self._files_read,
        )


class MergedTerms:
    """Terms, their lists and what is to be reviewed, from the stored states of several runs.

    ``states`` and ``keys`` are tables as ``MinedTerms.state`` and ``MinedTerms.term_keys`` give them, however they were
    stored.  No cell is read again.  The runs need one configuration, and paths that tell their files apart.
    """

    def __init__(
        self,
        states: Sequence[DataFrame],
        keys: Sequence[DataFrame],
        config: TermConfig,
        *,
        items_per_cell: int = ITEMS_PER_CELL,
    ):
        self._config, self._items_per_cell = config, items_per_cell
        self._states, self._all_keys = list(states), list(keys)

    @cached_property
    def state(self) -> DataFrame:
        return materialize(T.merged_state(self._states), "merged-state")

    @cached_property
    def terms(self) -> DataFrame:
        return T.terms(self.state, self._config.thresholds)

    @cached_property
    def term_files(self) -> DataFrame:
        return T.term_files(self.state)

    @cached_property
    def term_keys(self) -> DataFrame:
        return T.merged_keys(self._all_keys)

    @cached_property
    def _files(self) -> DataFrame:
        return list_cells(self.term_files, T.TERM, "file", items_per_cell=self._items_per_cell)

    @cached_property
    def terms_summary(self) -> DataFrame:
        keys = list_cells(self.term_keys, T.TERM, "key_value", items_per_cell=self._items_per_cell)
        return T.terms_summary(self.terms, self._files, keys)

    @cached_property
    def cross_file_terms(self) -> DataFrame:
        return R.cross_file_terms(self.terms, self._files)

    @cached_property
    def review(self) -> DataFrame:
        return T.review_items(self.terms)


def mine_terms(cells: DataFrame, config: TermConfig, **options) -> MinedTerms:
    """Extract, normalise, split, group and relate the terms of a cell table."""
    return MinedTerms(cells, config, **options)
