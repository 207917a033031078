"""Lists of sync jobs on one master table, as one plan: one scan of the master, one join.

What can fail about a job is found before anything runs: its table does not open, it lacks a column.  So
the jobs that can run are known, and they run together.  Forward jobs are rows tagged with their job; reverse
jobs are one winner per identity and job, folded over the cells of each master row in the order of the
jobs.  How many cells each job wrote is counted while the result is written.

A reverse job may write the key or the match text.  Then a row goes on under another identity: only the rows
that have a new one meet the winners again, for the jobs that are left.

With ``keep_changes`` a reverse batch keeps what every job replaced: a row per cell and job, from the pass that writes the
master.  The master before any of the jobs comes back from these rows (``restored``), without a copy of it.

Should the plan fail on the way (a file that breaks off), the jobs run one by one, to tell which.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.text import column as column_of
from keyweave.functions.text import is_blank
from keyweave.functions.winners import position
from keyweave.operators.joins import left_join_unique
from keyweave.operators.rows import (
    ID,
    SyncColumns,
    columns_at,
    identified_rows,
    nullable_text_of,
    text_of,
    with_identity,
)
from keyweave.operators.sync import WRITTEN, sync_multi
from keyweave.session import materialize
from keyweave.sources.writers import snapshot

FORWARD = "master_to_target_single"
REVERSE = "target_to_master_reverse"

Table = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class BatchJob:
    """One job: its target table, and the master column it reads or updates (name or 1-based position)."""

    target: str
    column: str | int
    name: str = ""


@dataclass(frozen=True)
class BatchConfig:
    """What all jobs share.  ``target`` holds key, match and the one column to write or read."""

    mode: str
    target: SyncColumns
    master_key: str
    master_match: str
    jobs: tuple[BatchJob, ...]
    fill_blank_only: bool = False
    allow_blank_write: bool = False
    continue_on_error: bool = True

    def errors(self) -> list[str]:
        found = []
        if self.mode not in (FORWARD, REVERSE):
            found.append(f"unknown mode {self.mode!r}: {FORWARD} or {REVERSE}")
        if not self.jobs:
            found.append("no jobs")
        if len(self.target.values) != 1:
            found.append("a job moves exactly one column")
        for nr, job in enumerate(self.jobs, start=1):
            if not job.target:
                found.append(f"job {nr}: no target")
            by_position = isinstance(job.column, int) and not isinstance(job.column, bool)
            if not (by_position and job.column > 0) and not (isinstance(job.column, str) and job.column):
                found.append(f"job {nr}: the column is a name, or a position from 1")
        for name in ("fill_blank_only", "allow_blank_write", "continue_on_error"):
            if not isinstance(getattr(self, name), bool):
                found.append(f"{name}: neither True nor False")
        return found

    def check(self) -> None:
        if found := self.errors():
            raise ValueError("\n".join(found))

    def source(self, master: DataFrame, job: BatchJob, service: Sequence[str] = ()) -> SyncColumns:
        column = job.column
        if isinstance(column, int):
            names = columns_at(master, column, ignore=service)
            if not names:
                raise ValueError(f"the master has no column {column}")
            column = names[0]
        return SyncColumns(self.master_key, self.master_match, (column,))


RESULT_SCHEMA = T.StructType(
    [
        T.StructField("job_index", T.IntegerType(), False),
        T.StructField("job_name", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("updated_count", T.LongType(), False),
        T.StructField("error", T.StringType(), False),
        T.StructField("elapsed_ms", T.LongType(), False),
    ]
)


@dataclass
class BatchRun:
    """Results per job, the targets each forward job wrote, and the master after all jobs."""

    mode: str
    jobs_total: int
    master: DataFrame
    results: list[tuple] = field(default_factory=list)
    outputs: dict[int, DataFrame] = field(default_factory=dict)
    stopped_early: bool = False
    backup_path: str = ""
    changes: list[DataFrame] = field(default_factory=list)

    def results_table(self) -> DataFrame:
        return self.master.sparkSession.createDataFrame(self.results, RESULT_SCHEMA)

    def before(self, job: int, place: Sequence[str]) -> DataFrame:
        """The master as it was before a job of this batch; needs ``keep_changes``.  ``place`` tells its rows apart."""
        return restored(self.master, self.changes, job, place)

    def summary_table(self) -> DataFrame:
        results = self.results_table()
        failed = (F.col("status") == "failed").cast("bigint")
        return results.agg(
            F.lit(self.mode).alias("mode"),
            F.lit(self.jobs_total).cast("bigint").alias("jobs_total"),
            F.coalesce(F.sum(1 - failed), F.lit(0)).cast("bigint").alias("jobs_succeeded"),
            F.coalesce(F.sum(failed), F.lit(0)).cast("bigint").alias("jobs_failed"),
            F.coalesce(F.sum("updated_count"), F.lit(0)).cast("bigint").alias("updated_total"),
            F.lit(self.stopped_early).alias("stopped_early"),
        )


def _open(tables: Mapping[str, Table], name: str) -> DataFrame:
    table = tables[name]
    return table() if callable(table) and not isinstance(table, DataFrame) else table


@dataclass(frozen=True)
class _Job:
    """A job that can run: its number, its target table and its master column."""

    number: int
    table: DataFrame
    column: str


def _checked(
    config: BatchConfig,
    number: int,
    master: DataFrame,
    targets: Mapping[str, Table],
    master_order: Sequence[str],
    target_order: Sequence[str],
) -> _Job:
    job = config.jobs[number - 1]
    table = _open(targets, job.target)
    own = config.target
    lacks = [c for c in dict.fromkeys((own.key, own.match, *own.values, *target_order)) if c not in table.columns]
    if lacks:
        raise ValueError(f"the target has no column {', '.join(lacks)}")
    column = config.source(master, job, master_order).values[0]
    if config.mode == REVERSE and column not in master.columns:
        raise ValueError(f"the master has no column {column}")
    return _Job(number, table, column)


def run_batch(
    config: BatchConfig,
    master: DataFrame,
    targets: Mapping[str, Table],
    *,
    master_order: Sequence[str],
    target_order: Sequence[str],
    backup_of: str | None = None,
    keep_changes: bool = False,
) -> BatchRun:
    """Run the jobs; results per job, what forward jobs made of their targets, and the master after reverse jobs.

    A failed job leaves nothing behind; with ``continue_on_error`` the others run as if it were not there, else
    those before it do.  ``elapsed_ms`` is the time of the plan that the job was part of.  ``backup_of`` is the path of
    the master; a copy of it is kept before a reverse batch.  With ``keep_changes``, ``master_order`` tells master rows apart.
    """
    config.check()
    if missing := [j.target for j in config.jobs if j.target not in targets]:
        raise ValueError(f"no such target table: {', '.join(missing)}")
    run = BatchRun(config.mode, len(config.jobs), master)
    if config.mode == REVERSE and backup_of:
        run.backup_path = snapshot(master, backup_of)
    orders = {"master_order": master_order, "target_order": target_order, "keep_changes": keep_changes}
    ready: list[_Job] = []
    outcomes: dict[int, tuple[str, int, str, int]] = {}
    for number in range(1, len(config.jobs) + 1):
        try:
            ready.append(_checked(config, number, master, targets, master_order, target_order))
        except Exception as failure:  # noqa: BLE001 - any failure of a job is a result
            outcomes[number] = ("failed", 0, str(failure), 0)
            if not config.continue_on_error:
                break
    waiting = [ready] if ready else []
    while waiting:
        jobs, started = waiting.pop(0), time.time()
        try:
            counts = _run_together(config, run, jobs, **orders)
        except Exception as failure:  # noqa: BLE001
            if len(jobs) > 1:
                waiting = [[job] for job in jobs]
                continue
            counts = {}
            outcomes[jobs[0].number] = ("failed", 0, str(failure), int((time.time() - started) * 1000))
            if not config.continue_on_error:
                outcomes = {n: o for n, o in outcomes.items() if n <= jobs[0].number}
                break
        elapsed = int((time.time() - started) * 1000)
        outcomes |= {number: ("success", count, "", elapsed) for number, count in counts.items()}
    for number in sorted(outcomes):
        run.results.append((number, config.jobs[number - 1].name or f"job-{number}", *outcomes[number]))
    failed = any(status == "failed" for status, *_ in outcomes.values())
    run.stopped_early = failed and not config.continue_on_error
    return run


def _run_together(
    config: BatchConfig,
    run: BatchRun,
    jobs: Sequence[_Job],
    *,
    master_order: Sequence[str],
    target_order: Sequence[str],
    keep_changes: bool,
) -> dict[int, int]:
    """Run some jobs as one plan, keep what they made in ``run``; the cells that each of them wrote."""
    seen = Observation("cells by job")
    if config.mode == FORWARD:
        result = _forward_plan(config, run.master, jobs, master_order, target_order)
        flags = {j.number: F.when(F.col("job_index") == j.number, F.col(WRITTEN)) for j in jobs}
    else:
        result = _reverse_plan(config, run.master, jobs, master_order, target_order, keep_changes)
        flags = {j.number: F.col(_write(j)).cast("bigint") for j in jobs}
    sums = [F.coalesce(F.sum(flag), F.lit(0)).alias(f"job_{number}") for number, flag in flags.items()]
    stored = materialize(result.observe(seen, *sums), "jobs")
    counts = {number: seen.get[f"job_{number}"] for number in flags}
    if config.mode == FORWARD:
        for job in jobs:
            own = [column_of(c) for c in (*job.table.columns, WRITTEN)]
            run.outputs[job.number] = stored.where(F.col("job_index") == job.number).select(*own)
    else:
        run.master = stored.select(*map(column_of, run.master.columns))
        if keep_changes:
            place = map(column_of, master_order)
            changes = stored.where(F.size(_CHANGES) > 0).select(*place, F.inline(_CHANGES))
            run.changes.append(materialize(changes, "changes"))
    return counts


def _all_checked(config: BatchConfig, master: DataFrame, targets, master_order, target_order) -> list[_Job]:
    config.check()
    numbers = range(1, len(config.jobs) + 1)
    return [_checked(config, i, master, targets, master_order, target_order) for i in numbers]


def forward_jobs(
    config: BatchConfig,
    master: DataFrame,
    targets: Mapping[str, Table],
    *,
    master_order: Sequence[str],
    target_order: Sequence[str],
) -> DataFrame:
    """The rows of all forward jobs, tagged with ``job_index``, as one lazy plan; a job that cannot run raises."""
    jobs = _all_checked(config, master, targets, master_order, target_order)
    return _forward_plan(config, master, jobs, master_order, target_order)


def _forward_plan(
    config: BatchConfig, master: DataFrame, jobs: Sequence[_Job], master_order: Sequence[str], target_order: Sequence[str]
) -> DataFrame:
    """The index holds the columns of all jobs; a row takes the one of its job."""
    value = config.target.values[0]
    tagged = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [job.table.withColumn("job_index", F.lit(job.number)) for job in jobs],
    )
    distinct = list(dict.fromkeys(job.column for job in jobs))
    # One value column per master column in use, filled for the rows of its jobs only.
    slots = {name: f"_slot_{i}" for i, name in enumerate(distinct)}
    of_slot = {slots[c]: F.col("job_index").isin([j.number for j in jobs if j.column == c]) for c in distinct}
    synced = sync_multi(
        tagged.withColumns({slot: column_of(value) for slot in of_slot}),
        SyncColumns(config.target.key, config.target.match, tuple(of_slot)),
        master,
        SyncColumns(config.master_key, config.master_match, tuple(distinct)),
        target_place=["job_index", *target_order],
        master_order=master_order,
        fill_blank_only=config.fill_blank_only,
        allow_blank_write=config.allow_blank_write,
        only=of_slot,
    )
    chosen = F.lit(None).cast("string")
    for slot, own in of_slot.items():
        chosen = F.when(own, F.col(slot)).otherwise(chosen)
    return synced.withColumn(value, chosen).drop(*of_slot)


def reverse_jobs(
    config: BatchConfig,
    master: DataFrame,
    targets: Mapping[str, Table],
    *,
    master_order: Sequence[str],
    target_order: Sequence[str],
) -> DataFrame:
    """The master after all reverse jobs with the cells written per row; a job that cannot run raises.

    Each job sees the cells, and the identities, that its predecessors left.
    """
    jobs = _all_checked(config, master, targets, master_order, target_order)
    rows = _reverse_plan(config, master, jobs, master_order, target_order)
    written = reduce(Column.__add__, [F.col(_write(job)).cast("int") for job in jobs])
    return rows.select(*map(column_of, master.columns), written.cast("bigint").alias(WRITTEN))


def _new(job: _Job) -> str:
    return f"_new_{job.number}"


def _write(job: _Job) -> str:
    return f"_write_{job.number}"


def _winners(config: BatchConfig, jobs: Sequence[_Job], target_order: Sequence[str]) -> DataFrame:
    """One row per identity with the value of its last target row in every job, NULL without one."""
    key, match, value = config.target.key, config.target.match, config.target.values[0]

    def values(job: _Job) -> DataFrame:
        content = text_of(job.table, value)
        rows = job.table if config.allow_blank_write else job.table.filter(~is_blank(content))
        return identified_rows(rows, key, match).select(
            ID, *target_order, content.alias("_content"), F.lit(job.number).alias("_job")
        )

    tagged = reduce(DataFrame.unionByName, map(values, jobs))
    place = position(target_order)
    return tagged.groupBy(ID).agg(
        *(F.max_by("_content", F.when(F.col("_job") == job.number, place)).alias(_new(job)) for job in jobs)
    )


_CHANGES = "_changes"


def restored(master: DataFrame, changes: Sequence[DataFrame], job: int, place: Sequence[str]) -> DataFrame:
    """The master as it was before ``job``, from the rows after all jobs and what jobs replaced.

    ``changes`` has a row per cell that a job wrote: the columns ``place``, job, column and old.  The oldest text that this
    job or a later one replaced is what a cell had before.
    """
    if not changes:
        return master
    later = reduce(DataFrame.unionByName, changes).where(F.col("job") >= job)
    cells = later.groupBy(*place, "column").agg(F.min_by("old", "job").alias("old"))
    entries = F.map_from_entries(F.collect_list(F.struct("column", "old")))  # as many as the master has columns
    rows = left_join_unique(master, cells.groupBy(*place).agg(entries.alias("_old")), place, place)
    written = {r["column"] for r in later.select("column").distinct().collect()}
    before = [
        F.when(F.map_contains_key("_old", F.lit(c)), F.element_at("_old", F.lit(c))).otherwise(column_of(c)).alias(c)
        if c in written
        else column_of(c)
        for c in master.columns
    ]
    return rows.select(*before)


def _reverse_plan(
    config: BatchConfig,
    master: DataFrame,
    jobs: Sequence[_Job],
    master_order: Sequence[str],
    target_order: Sequence[str],
    keep_changes: bool = False,
) -> DataFrame:
    """The master with the cells of all jobs, and per job whether it wrote a cell of the row."""
    parts = {config.master_key, config.master_match}
    winners = _winners(config, jobs, target_order)
    segments: list[list[_Job]] = [[]]
    for job in jobs:
        segments[-1].append(job)
        if job.column in parts:
            segments.append([])
    segments = [segment for segment in segments if segment]
    if len(segments) > 1:
        winners = materialize(winners, "winners")

    written = list(dict.fromkeys(job.column for job in jobs))
    texts = {c: nullable_text_of(master, c) for c in written}
    identified = with_identity(master, config.master_key, config.master_match).withColumns(texts)
    rows = left_join_unique(identified, winners, [ID], master_order)
    if keep_changes:
        none = F.array().cast("array<struct<job: int, column: string, old: string>>")
        rows = rows.withColumn(_CHANGES, none)
    waiting = list(jobs)
    for segment in segments:
        for job in segment:
            rows = _folded(config, rows, job, keep_changes)
            waiting.remove(job)
        rows = rows.drop(*map(_new, segment))
        if waiting:
            rows = _rekeyed(config, rows, winners, waiting, master_order)
    return rows.drop(ID)


def _folded(config: BatchConfig, rows: DataFrame, job: _Job, keep_changes: bool = False) -> DataFrame:
    """One job more: its value goes into the cell, if the rules allow it."""
    write = F.col(_new(job)).isNotNull()
    if config.fill_blank_only:
        write = write & is_blank(column_of(job.column))
    cell = F.when(F.col(_write(job)), F.col(_new(job))).otherwise(column_of(job.column))
    rows = rows.withColumn(_write(job), write)
    if keep_changes:
        change = F.struct(
            F.lit(job.number).alias("job"), F.lit(job.column).alias("column"), column_of(job.column).alias("old")
        )
        rows = rows.withColumn(_CHANGES, F.when(F.col(_write(job)), F.array_append(_CHANGES, change)).otherwise(F.col(_CHANGES)))
    return rows.withColumn(job.column, cell)


def _rekeyed(
    config: BatchConfig, rows: DataFrame, winners: DataFrame, waiting: Sequence[_Job], master_order: Sequence[str]
) -> DataFrame:
    """Rows whose key or match text has changed get the winners of their new identity, for the jobs that are left."""
    before = "_id_before"
    renamed = with_identity(rows.withColumnRenamed(ID, before), config.master_key, config.master_match)
    moved = ~F.col(ID).eqNullSafe(F.col(before))
    stay = renamed.where(~moved).drop(before)
    go = materialize(renamed.where(moved).drop(before, *map(_new, waiting)), "moved")
    found = left_join_unique(go, winners.select(ID, *map(_new, waiting)), [ID], master_order)
    return stay.unionByName(found)
