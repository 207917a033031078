"""The tools of the library on folders: read, compute, write what changed.

Each function reads its folders with ``scan_folder``, so a file that cannot be read is
reported in ``errors`` and the others are processed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.operators.coverage import MEASURES, report_of, untranslated_stats
from keyweave.operators.replace import Replacement, replace_files
from keyweave.operators.rows import Layout, SyncColumns
from keyweave.operators.sync import WRITTEN, sync_multi, sync_reverse
from keyweave.plans.batch import FORWARD, BatchConfig, BatchRun, run_batch
from keyweave.plans.master_update import (
    MasterUpdate,
    UpdatePolicies,
    source_then_translation,
    update_master_table,
)
from keyweave.plans.mine_terms import MinedTerms, mine_terms
from keyweave.plans.term_config import TermConfig
from keyweave.session import materialize
from keyweave.sources import readers as R
from keyweave.sources.commits import (
    E_TARGET_SAVE,
    FAILED,
    LOG,
    REPLACED,
    commit_changed_files,
    commit_written_rows,
    errors_of,
    replace_by_name,
)
from keyweave.sources.writers import path_exists, write_changed_files, write_report


@dataclass(frozen=True)
class FolderRun:
    """The result of a tool, the files that could not be read, and the files written."""

    result: DataFrame | MasterUpdate | MinedTerms | Replacement
    errors: DataFrame
    changed: DataFrame | None = None


def sync_folder(
    spark: SparkSession,
    master: DataFrame,
    source: SyncColumns,
    folder: str,
    target: SyncColumns,
    *,
    master_order: Sequence[str],
    out: str | None = None,
    in_place: bool = False,
    state: str | None = None,
    fill_blank_only: bool = False,
    allow_blank_write: bool = False,
    **scan,
) -> FolderRun:
    """Master values into every file of a folder.

    Changed files are written to ``out``, another folder, or ``in_place``: then each Parquet file is exchanged on its
    own, with its cells as text, and one that cannot be written is an error row and keeps its content.

    ``state`` is a folder for the files that are done, in place: their length and time of change, and a digest of the master and of
    what is asked.  A later run with the same digest reads none of them until they change.
    """
    if out and in_place:
        raise ValueError("changed files go to another folder or stay in their places, not both")
    if state and not in_place:
        raise ValueError("only files that are synced in their places have a state")
    if out:
        _check_apart(folder, out)
    digest, done = None, None
    if state:
        digest = _digest(master, source, target, master_order, fill_blank_only, allow_blank_write)
        done = _done_files(spark, state, digest)
    read = R.scan_folder(spark, folder, error_code=R.E_TARGET_READ, done=done, **scan)

    def synced(rows: DataFrame) -> DataFrame:
        return sync_multi(
            rows,
            target,
            master,
            source,
            target_place=[R.FILE, R.ROW],
            master_order=master_order,
            fill_blank_only=fill_blank_only,
            allow_blank_write=allow_blank_write,
        )

    if in_place:
        run = _committed(spark, read, synced)
        if state:
            _keep_done(run, read, folder, state, digest)
        return run
    result = synced(read.rows)
    return FolderRun(result, read.errors, write_changed_files(result, out, file=R.FILE) if out else None)


def _digest(master: DataFrame, source: SyncColumns, target: SyncColumns, order: Sequence[str], *flags: bool) -> str:
    """A number for the rows of a master, in whatever order they are stored, and for what is asked of it."""
    columns = list(dict.fromkeys([*order, source.key, source.match, *source.values]))
    row = F.xxhash64(*(F.col(f"`{c}`") for c in columns if c in master.columns))
    sums = master.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("sum")).first()
    return f"{sums['n']} {sums['sum']} {source} {target} {tuple(order)} {flags}"


def _done_files(spark: SparkSession, state: str, digest: str) -> DataFrame:
    if not path_exists(spark, state):
        return spark.createDataFrame([], _DONE).drop("digest")
    return spark.read.schema(_DONE).parquet(state).where(F.col("digest") == digest).drop("digest").distinct()


_DONE = "path string, length bigint, modified timestamp, digest string"


def _keep_done(run: FolderRun, read: R.FolderScan, folder: str, state: str, digest: str) -> None:
    """Add the files that were read, and written if they had to be, as they are now."""
    failed = run.errors.select("path").withColumn("path", R._same_form(F.col("path")))
    now = R.list_files(read.files.sparkSession, folder, ("",))
    now = now.withColumn("_form", R._same_form(F.col("path")))
    read_well = read.files.select(F.col("path").alias("_form")).join(failed.withColumnRenamed("path", "_form"), "_form", "left_anti")
    rows = now.join(read_well, "_form", "left_semi").select("path", "length", "modified", F.lit(digest).alias("digest"))
    rows.coalesce(1).write.mode("append").parquet(state)


def _committed(spark: SparkSession, read: R.FolderScan, synced: Callable[[DataFrame], DataFrame]) -> FolderRun:
    """Exchange the files of a scan that ``synced`` changes; ``result`` is the log of the exchanges.

    Files of each schema are written apart, so that none gets a column of another one.
    """
    place = {"file": R.FILE, "row": R.ROW, "service": R.SERVICE}
    return _exchanged(spark, read, [commit_changed_files(table, synced, **place) for table in read.tables])


def _exchanged(spark: SparkSession, read: R.FolderScan, commits: Sequence[tuple[DataFrame, DataFrame]]) -> FolderRun:
    none = (spark.createDataFrame([], f"{R.FILE} string, {WRITTEN} bigint"), spark.createDataFrame([], LOG))
    counts, log = (reduce(DataFrame.unionByName, tables) for tables in zip(none, *commits))
    written = log.where(F.col("status") != FAILED).select(F.col("path").alias(R.FILE))
    failed = errors_of(log, E_TARGET_SAVE)
    return FolderRun(
        log, read.errors.unionByName(failed, allowMissingColumns=True), counts.join(written, R.FILE, "left_semi")
    )


@dataclass(frozen=True)
class FolderBatch:
    """A batch of forward jobs on folders: results per job, and per job the files written and the errors."""

    run: BatchRun
    folders: dict[int, FolderRun]


def batch_on_folders(
    spark: SparkSession,
    config: BatchConfig,
    master: DataFrame,
    folders: Mapping[str, str],
    *,
    master_order: Sequence[str],
    **scan,
) -> FolderBatch:
    """Run the jobs of a batch on the folders their targets name: forward jobs exchange the files that they change.

    All jobs are one plan.  A folder that cannot be read fails its job; a file that cannot be read or written is an
    error of its job.  After a reverse batch the new master is in ``run``; its folders are only read.
    """
    reads: dict[str, R.FolderScan] = {}

    def opened(name: str) -> DataFrame:
        if name not in reads:
            reads[name] = R.scan_folder(spark, folders[name], error_code=R.E_TARGET_READ, **scan)
        rows = reads[name].rows
        return rows if config.mode == FORWARD else R.order_by_path(rows)

    order = [R.FILE, R.ROW] if config.mode == FORWARD else R.FOLDER_ORDER
    targets = {job.target: partial(opened, job.target) for job in config.jobs if job.target in folders}
    run = run_batch(config, master, targets, master_order=master_order, target_order=order)
    done: dict[int, FolderRun] = {}
    for number, rows in run.outputs.items():
        read, commits = reads[config.jobs[number - 1].target], []
        for table in read.tables:
            own = rows.join(table.select(R.FILE).distinct(), R.FILE, "left_semi")
            own = own.select(*(F.col(f"`{c}`") for c in (*table.columns, WRITTEN)))
            commits.append(commit_written_rows(own, file=R.FILE, row=R.ROW, service=R.SERVICE))
        done[number] = _exchanged(spark, read, commits)
    return FolderBatch(run, done)


def _check_apart(folder: str, out: str) -> None:
    """A folder cannot be rewritten while it is read."""
    one, other = R._plain_path(folder) + "/", R._plain_path(out) + "/"
    if one.startswith(other) or other.startswith(one):
        raise ValueError(f"{out} must lie apart from {folder}, which is read")


def reverse_folder(
    spark: SparkSession,
    master: DataFrame,
    source: SyncColumns,
    folder: str,
    target: SyncColumns,
    *,
    master_place: Sequence[str],
    fill_blank_only: bool = False,
    allow_blank_write: bool = False,
    **scan,
) -> FolderRun:
    """Values from all files of a folder, in the order of their paths, into the master."""
    read = R.scan_folder(spark, folder, error_code=R.E_TARGET_READ, **scan)
    result = sync_reverse(
        master,
        source,
        R.order_by_path(read.rows),
        target,
        master_place=master_place,
        target_order=R.FOLDER_ORDER,
        fill_blank_only=fill_blank_only,
        allow_blank_write=allow_blank_write,
    )
    return FolderRun(result, read.errors)


def update_from_folder(
    spark: SparkSession,
    master: DataFrame,
    folder: str,
    layout: Layout,
    policies: UpdatePolicies = UpdatePolicies(),
    *,
    row: str,
    priority: Sequence[str] = (),
    master_path: str | None = None,
    exclude: Sequence[str] = (),
    **scan,
) -> FolderRun:
    """Update a master from a folder, in the order of file names or of the paths listed.

    The file ``master_path`` is the master itself and no source, should it lie in the folder.
    """
    left_out = [*exclude, *([master_path] if master_path else [])]
    read = R.scan_folder(spark, folder, error_code=R.E_SOURCE_READ, exclude=left_out, **scan)
    rows = R.order_by_priority(read.rows, priority) if priority else R.order_by_name(read.rows)
    files = R.listed_first(read.files, priority) if priority else read.files
    result = update_master_table(
        master, rows, layout, policies, row=row, order=R.FOLDER_ORDER, file=R.FILE, files=files
    )
    return FolderRun(result, read.errors)


def two_stages_from_folders(
    spark: SparkSession,
    master: DataFrame,
    source_folder: str,
    translation_folder: str,
    layout: Layout,
    *,
    row: str,
    master_path: str | None = None,
    **scan,
) -> tuple[FolderRun, FolderRun]:
    """A dense update from one folder, then a sparse update of its result from another one.

    The files of each folder come in the order of their names.
    """
    left_out = [master_path] if master_path else []
    reads = [
        R.scan_folder(spark, folder, error_code=R.E_SOURCE_READ, exclude=left_out, **scan)
        for folder in (source_folder, translation_folder)
    ]
    stages = source_then_translation(
        master,
        *(R.order_by_name(read.rows) for read in reads),
        layout,
        row=row,
        order=R.FOLDER_ORDER,
        file=R.FILE,
    )
    return tuple(
        FolderRun(replace(stage, parts=replace(stage.parts, files=read.files)), read.errors)
        for stage, read in zip(stages, reads, strict=True)
    )


def mine_folder(spark: SparkSession, folder: str, config: TermConfig, **scan) -> FolderRun:
    """The terms of the files the configuration names; files without its columns are errors."""
    read = R.scan_folder(
        spark,
        folder,
        tokens=config.files,
        required=config.required_columns(),
        error_code=R.E_TERMINOLOGY_FILE,
        **scan,
    )
    mined = mine_terms(
        read.rows,
        config,
        path=R.FILE,
        row=R.ROW,
        file=R.NAME,
        files_failed=read.files_failed,
        files_read=read.files_read,
    )
    return FolderRun(mined, read.errors)


def stats_of_folder(
    spark: SparkSession, folder: str, *, source: str, translation: str, mode: str = "chinese_chars", **scan
) -> FolderRun:
    """Untranslated text per file: path, file_name and the four sums.

    Files of one name in two folders are two rows; files without rows and files that cannot be
    read count 0.
    """
    read = R.scan_folder(spark, folder, error_code=R.E_STATS_FILE, **scan)
    paths = read.files.select("path").unionByName(read.errors.select("path"))
    stats = untranslated_stats(
        read.rows,
        file=R.FILE,
        source=source,
        translation=translation,
        mode=mode,
        files=paths.withColumnRenamed("path", "file_name"),
    )
    name = F.element_at(F.split("file_name", "/"), -1)
    named = stats.select(F.col("file_name").alias("path"), name.alias("file_name"), *MEASURES)
    return FolderRun(named, read.errors)


def stats_report_of_folder(
    spark: SparkSession, folder: str, *, out: str | None = None, stem: str = "untranslated_stats", mode: str = "chinese_chars", **options
) -> FolderRun:
    """The statistics of a folder as a report with totals in its last row; written below ``out`` if it is given.

    A report never replaces an earlier one; ``changed`` has the path of the new one.
    """
    run = stats_of_folder(spark, folder, mode=mode, **options)
    report = report_of(materialize(run.result, "stats"), mode)
    if out is None:
        return FolderRun(report, run.errors)
    path = write_report(report.coalesce(1), out, stem)
    return FolderRun(report, run.errors, spark.createDataFrame([(path,)], "path string"))


def edit_folder(
    spark: SparkSession, folder: str, edit: Callable[..., DataFrame], number: int, out: str, **scan
) -> FolderRun:
    """One column edit (clear, insert or delete) in every file of a folder, written to ``out``.

    The position counts the columns of the file itself, so files of each schema are edited
    apart.  ``out`` must not exist yet, so that no run adds to another.  ``result`` lists the files.
    """
    _check_apart(folder, out)
    read = R.scan_folder(spark, folder, error_code=R.E_EDIT_COLUMN, **scan)
    for nr, table in enumerate(read.tables):
        edited = edit(table, number, service=R.SERVICE)
        edited.write.mode("append" if nr else "errorifexists").partitionBy(R.FILE).parquet(out)
    return FolderRun(read.files, read.errors)


def replace_from_folder(spark: SparkSession, source_folder: str, target_folder: str, **scan) -> FolderRun:
    """Files of the target folder replaced by the files of the same name of the source folder."""
    sources = R.scan_folder(spark, source_folder, error_code=R.E_REPLACE_FILE, **scan)
    targets = R.scan_folder(spark, target_folder, error_code=R.E_REPLACE_FILE, **scan)

    def listed(files: DataFrame) -> DataFrame:
        return files.select(F.col("path").alias(R.FILE), F.col("file_name").alias(R.NAME))

    result = replace_files(
        targets.rows,
        sources.rows,
        path=R.FILE,
        name=R.NAME,
        target_files=listed(targets.files),
        source_files=listed(sources.files),
    )
    return FolderRun(result, sources.errors.unionByName(targets.errors))


def replace_in_folder(
    spark: SparkSession, source_folder: str, target_folder: str, *, extensions: Sequence[str] = (".parquet",)
) -> FolderRun:
    """Files of the target folder replaced, in their places, by the files of the same name of the source folder.

    Files are copied as they are, whatever they hold; files of no bytes at all are not listed.  A file that cannot be replaced keeps its content and is an error row.
    ``result`` is the log of all source files, those without a target with status ``unmatched``; ``changed`` lists the files that
    have new content.  A second run finds equal content and changes nothing.
    """
    _check_apart(source_folder, target_folder)
    targets, sources = (
        R.list_files(spark, folder, extensions, case_sensitive=True) for folder in (target_folder, source_folder)
    )
    log, unmatched = replace_by_name(spark, targets, sources)
    missing = unmatched.select(F.col("source_path").alias("source"), F.lit("unmatched").alias("status"))
    return FolderRun(
        log.unionByName(missing, allowMissingColumns=True),
        errors_of(log, R.E_REPLACE_FILE),
        log.where(F.col("status") == REPLACED).select("path"),
    )
