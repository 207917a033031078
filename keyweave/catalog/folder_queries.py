"""Tools on folders of files: the files are written, worked on in their places, and read again.

``part`` is a folder with one file per brand, ``lineitem`` one with a file per return flag and line status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.catalog import sync_queries as S
from keyweave.catalog.base import Query, sql_blank, table
from keyweave.plans.folders import FolderRun, replace_in_folder, sync_folder
from keyweave.session import intermediate_path
from keyweave.sources import readers as R
from keyweave.sources.commits import write_files


def _folder(rows: DataFrame, name: str, *, row: list[str]) -> str:
    """Write ``rows`` as a folder with a Parquet file per value of the column ``file``."""
    place = intermediate_path(rows.sparkSession, name)
    write_files(rows.withColumn("file", F.concat(F.lit(f"{place}/"), "file", F.lit(".parquet"))), file="file", row=row)
    return place


def _stem(file: str = R.NAME):
    return F.regexp_replace(file, "[.]parquet$", "")


def _replaced(spark: SparkSession, folder: str) -> tuple[str, FolderRun]:
    """Files of brands replaced by files with the names in capitals; one brand has no file of its name."""
    parts = table(spark, folder, "part").select(F.col("p_brand").alias("file"), "p_partkey", "p_name")
    renamed = F.when(F.col("file").endswith("2"), F.concat("file", F.lit(" new"))).otherwise(F.col("file"))
    targets = _folder(parts, "targets", row=["p_partkey"])
    sources = parts.select(renamed.alias("file"), "p_partkey", F.upper("p_name").alias("p_name"))
    return targets, replace_in_folder(spark, _folder(sources, "sources", row=["p_partkey"]), targets)


def _replaced_rows(spark: SparkSession, folder: str) -> DataFrame:
    targets, _ = _replaced(spark, folder)
    rows = R.scan_folder(spark, targets).rows
    return rows.select(_stem().alias("p_brand"), F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name")


def _replacement_log(spark: SparkSession, folder: str) -> DataFrame:
    _, run = _replaced(spark, folder)
    name = F.element_at(F.split("source", "/"), -1).alias("name")
    return run.result.select(_stem_of(name), "status", F.coalesce("stage", F.lit("")).alias("stage"))


def _stem_of(name):
    return F.regexp_replace(name, "[.]parquet$", "").alias("source_name")


def _synced(spark: SparkSession, folder: str) -> tuple[str, FolderRun]:
    """Part names into the untranslated lines of all files; files of shipped lines have nothing to fill."""
    lines = S.forward_targets(spark, folder).drop("size_text")
    lines = lines.withColumn("file", F.concat_ws(" ", "file", F.when(F.col("translation") == "", "open").otherwise("done")))
    place = _folder(lines, "lines", row=S.LINE)
    run = sync_folder(
        spark,
        S.forward_master(spark, folder),
        S.MASTER_ONE,
        place,
        S.TARGET_ONE,
        master_order=["p_partkey"],
        in_place=True,
        fill_blank_only=True,
    )
    return place, run


def _synced_rows(spark: SparkSession, folder: str) -> DataFrame:
    place, _ = _synced(spark, folder)
    rows = R.scan_folder(spark, place).rows
    numbers = [F.col(c).cast("bigint").alias(c) for c in S.LINE if c != "l_shipdate"]
    return rows.select(_stem().alias("file"), *numbers, "key", "match", "translation")


def _synced_files(spark: SparkSession, folder: str) -> DataFrame:
    _, run = _synced(spark, folder)
    return run.changed.select(_stem_of(F.element_at(F.split(R.FILE, "/"), -1)).alias("file"), "cells_written")


_FILL = f"new_name IS NOT NULL AND NOT {sql_blank('new_name')} AND {sql_blank('translation')}"
_FILE = "file || CASE WHEN translation = '' THEN ' open' ELSE ' done' END"

QUERIES = {
    "replace_files_committed": Query(
        _replaced_rows,
        """SELECT p_brand, CAST(p_partkey AS BIGINT) AS p_partkey,
       CASE WHEN p_brand LIKE '%2' THEN p_name ELSE upper(p_name) END AS p_name FROM part""",
    ),
    "replace_files_log": Query(
        _replacement_log,
        """SELECT DISTINCT p_brand || CASE WHEN p_brand LIKE '%2' THEN ' new' ELSE '' END AS source_name,
       CASE WHEN p_brand LIKE '%2' THEN 'unmatched' ELSE 'replaced' END AS status, '' AS stage FROM part""",
    ),
    "sync_files_committed": Query(
        _synced_rows,
        f"""{S.FORWARD_SQL}
SELECT {_FILE} AS file, l_orderkey, l_linenumber, l_partkey, l_suppkey, key, match,
       CASE WHEN {_FILL} THEN new_name ELSE translation END AS translation FROM joined""",
    ),
    "sync_files_changed": Query(
        _synced_files,
        f"""{S.FORWARD_SQL}
SELECT {_FILE} AS file, CAST(count(*) AS BIGINT) AS cells_written FROM joined WHERE {_FILL} GROUP BY 1""",
    ),
}
