"""Results out: changed files, reports, exports and snapshots."""

from __future__ import annotations

import posixpath
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keyweave.operators.joins import inner_join_unique
from keyweave.operators.sync import WRITTEN
from keyweave.session import materialize

# Fixed value: the name of the report of unmatched update rows.
UNMATCHED_REPORT = "translation_unmatched_report"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def fresh_path(spark: SparkSession, folder: str, stem: str) -> str:
    """``folder/stem``, or the first ``stem (n)`` that does not exist."""
    candidate, nr = f"{folder.rstrip('/')}/{stem}", 0
    while path_exists(spark, candidate):
        nr += 1
        candidate = f"{folder.rstrip('/')}/{stem} ({nr})"
    return candidate


def _options(kind: str) -> dict[str, str]:
    return {"header": "true"} if kind == "csv" else {}


def write_changed_files(result: DataFrame, folder: str, *, file: str, kind: str = "parquet") -> DataFrame:
    """Write the files in which a cell was written, and no other; returns (file, cells written).

    A first pass counts the writes per file and reads only the columns the sync needs; a
    second one writes whole rows, of the changed files only.  Each file is one partition of
    the folder, and large files are split over several tasks.  A folder of that kind
    may be rewritten from its own rows: partitions are exchanged when all tasks are done.  A
    folder of plain files is not, they would stay beside the new ones.  CSV files get a header.
    """
    counts = result.groupBy(file).agg(F.sum(WRITTEN).alias(WRITTEN)).filter(F.col(WRITTEN) > 0)
    changed = materialize(counts, "changed-files")
    if not changed.isEmpty():
        rows = inner_join_unique(result.drop(WRITTEN), changed.select(file), [file])
        (
            rows.hint("rebalance", F.col(file))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(file)
            .format(kind)
            .options(**_options(kind))
            .save(folder)
        )
    return changed


def write_master(update, path: str, *, kind: str = "parquet") -> DataFrame:
    """Write the new master to a new place; the counters of the update come from the same pass."""
    if not update.cell_counts:
        update.master.write.mode("errorifexists").format(kind).options(**_options(kind)).save(path)
        return update.counters
    seen = Observation("cell counts")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in update.cell_counts]
    observed = update.rows.observe(seen, *sums).drop(*update.cell_counts)
    observed.write.mode("errorifexists").format(kind).options(**_options(kind)).save(path)
    return update.counters_with(seen.get)


def write_report(report: DataFrame, folder: str, stem: str = UNMATCHED_REPORT, *, kind: str = "parquet") -> str:
    """Write a report beside earlier ones, also an empty one; returns its path."""
    path = fresh_path(report.sparkSession, folder, stem)
    report.write.mode("errorifexists").format(kind).options(**_options(kind)).save(path)
    return path


def write_term_reports(mined, folder: str, *, kind: str = "parquet") -> dict[str, str]:
    """The four reports of a terminology run, one table each, under one folder."""
    tables = {
        "terms_summary": mined.terms_summary,
        "relations_summary": mined.relations_summary,
        "review": mined.review,
        "details": mined.details,
    }
    paths = {}
    for name, table in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        table.write.mode("errorifexists").format(kind).options(**_options(kind)).save(paths[name])
    return paths


def snapshot(table: DataFrame, path: str) -> str:
    """A Parquet copy of a master beside it, named after the time to the microsecond."""
    folder, base = posixpath.split(path.rstrip("/"))
    stem, _ = posixpath.splitext(base)
    stamp = datetime.now().strftime("%Y%m%d_%H%M%S_%f")
    copy = posixpath.join(folder, f"{stem}.batch_backup.{stamp}.parquet")
    table.write.mode("errorifexists").parquet(copy)
    return copy
