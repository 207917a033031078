"""Replace the files of one folder by the files of the same name of another folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators.joins import inner_join_unique, rows_absent_from
from keyweave.session import materialize


@dataclass(frozen=True)
class Replacement:
    """The target table after the replacement, which file replaced which, and the rest."""

    targets: DataFrame
    replaced: DataFrame
    unmatched: DataFrame


def replace_files(
    targets: DataFrame,
    sources: DataFrame,
    *,
    path: str,
    name: str,
    target_files: DataFrame | None = None,
    source_files: DataFrame | None = None,
) -> Replacement:
    """Rows of source files take the place of the rows of the target file of the same name.

    Of several target files of one name the first by path is replaced; of several source
    files of one name the last by path is taken.  Columns only one side has are empty on the
    other one.  The lists of files (``path`` and ``name``) add files without rows: an empty source
    file empties its target.
    """
    target_files = (target_files or targets).groupBy(name).agg(F.min(path).alias("target_path"))
    source_files = (source_files or sources).groupBy(name).agg(F.max(path).alias("source_path"))
    # One row per file name: written once, so that the planner knows how small it is.
    files = materialize(source_files.join(target_files, name, "left"), "file-pairs")
    replaced = files.filter(F.col("target_path").isNotNull())

    kept = rows_absent_from(targets, replaced.select(F.col("target_path").alias(path)), [path])
    taken = inner_join_unique(sources, replaced.withColumnRenamed("source_path", path).drop(name), [path])
    taken = taken.withColumn(path, F.col("target_path")).drop("target_path")
    return Replacement(
        kept.unionByName(taken, allowMissingColumns=True),
        replaced,
        files.filter(F.col("target_path").isNull()).select(name, "source_path"),
    )
