"""Column edits, file replacement and table comparison over ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.catalog.base import Query, table
from keyweave.operators.columns import clear_column, delete_column, insert_column
from keyweave.operators.diff import diff_cells, diff_tables
from keyweave.operators.replace import replace_files


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part")


def _replacement(spark: SparkSession, folder: str, *, with_empty_file: bool = False):
    """Target files by brand folder and type; source files are named by type, one name is new.

    The empty file has the name of the type that has no source file of its own.
    """
    parts = _parts(spark, folder)
    targets = parts.select(
        F.concat(F.lit("target/"), "p_brand", F.lit("/"), "p_type").alias("path"),
        F.col("p_type").alias("file_name"),
        "p_partkey",
        "p_name",
    )
    name = F.when(F.col("p_type") == "PROMO", "PROMO_NEW").otherwise(F.col("p_type"))
    sources = parts.select(
        F.concat(F.lit("source/"), "p_brand", F.lit("/"), name).alias("path"),
        name.alias("file_name"),
        "p_partkey",
        F.upper("p_name").alias("p_name"),
    )
    files = None
    if with_empty_file:
        empty = spark.range(1).select(F.lit("source/empty/PROMO").alias("path"), F.lit("PROMO").alias("file_name"))
        files = sources.select("path", "file_name").distinct().union(empty)
    return replace_files(targets, sources, path="path", name="file_name", source_files=files)


_REPLACE_SQL = """
WITH target AS (
  SELECT 'target/' || p_brand || '/' || p_type AS path, p_type AS file_name, p_partkey, p_name FROM part
), source AS (
  SELECT 'source/' || p_brand || '/' || n AS path, n AS file_name, p_partkey, upper(p_name) AS p_name
  FROM (SELECT *, CASE WHEN p_type = 'PROMO' THEN 'PROMO_NEW' ELSE p_type END AS n FROM part)
), pairs AS (
  SELECT s.file_name, s.path AS source_path, t.path AS target_path
  FROM (SELECT file_name, max(path) AS path FROM source GROUP BY 1) s
  LEFT JOIN (SELECT file_name, min(path) AS path FROM target GROUP BY 1) t USING (file_name)
)"""


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` with some cells changed or emptied, one type in other rows and one more column."""
    moved = F.when(F.col("p_type") == "PROMO", F.lit(_MOVED)).otherwise(F.lit(0))
    return _parts(spark, folder).select(
        (F.col("p_partkey") + moved).alias("p_partkey"),
        F.when(F.col("p_size") != 9, F.col("p_name")).alias("p_name"),
        F.col("p_brand"),
        F.col("p_type"),
        F.when(F.col("p_size") == 10, 100).otherwise(F.col("p_size")).alias("p_size"),
        F.when(F.col("p_size") == 11, "more").alias("extra"),
    )


#: Beyond every part key.
_MOVED = 10_000_000_000


_DIFF_CELLS = [
    ("p_name", "p_name"),
    ("p_brand", "p_brand"),
    ("p_type", "p_type"),
    ("CAST(p_size AS VARCHAR)", "CAST(p_size AS VARCHAR)"),
    ("NULL", "extra"),
]
_DIFF_SQL = f"""
WITH actual AS (
  SELECT p_partkey + CASE WHEN p_type = 'PROMO' THEN {_MOVED} ELSE 0 END AS p_partkey,
         CASE WHEN p_size <> 9 THEN p_name END AS p_name, p_brand, p_type,
         CASE WHEN p_size = 10 THEN 100 ELSE p_size END AS p_size,
         CASE WHEN p_size = 11 THEN 'more' END AS extra
  FROM part
), e AS ({' UNION ALL '.join(f"SELECT p_partkey AS row, {i} AS col, CAST({c} AS VARCHAR) AS v FROM part" for i, (c, _) in enumerate(_DIFF_CELLS, 1))}
), a AS ({' UNION ALL '.join(f"SELECT p_partkey AS row, {i} AS col, CAST({c} AS VARCHAR) AS v FROM actual" for i, (_, c) in enumerate(_DIFF_CELLS, 1))}
), diffs AS (
  SELECT row, CAST(col AS BIGINT) AS col, e.v AS expected, a.v AS actual
  FROM e FULL JOIN a USING (row, col) WHERE e.v IS DISTINCT FROM a.v
)"""


def _compared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _parts(spark, folder).drop("p_retailprice"), _changed(spark, folder)


QUERIES = {
    "clear_column": Query(
        lambda s, d: clear_column(_parts(s, d), 2),
        "SELECT p_partkey, CAST(NULL AS VARCHAR) AS p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    ),
    "insert_column": Query(
        lambda s, d: insert_column(_parts(s, d), 3),
        'SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS "Translation", p_brand, p_type, p_size, p_retailprice FROM part',
    ),
    "delete_column": Query(
        lambda s, d: delete_column(_parts(s, d), 5),
        "SELECT p_partkey, p_name, p_brand, p_type, p_retailprice FROM part",
    ),
    "replace_files": Query(
        lambda s, d: _replacement(s, d).targets,
        f"""{_REPLACE_SQL}
SELECT * FROM target WHERE path NOT IN (SELECT target_path FROM pairs WHERE target_path IS NOT NULL)
UNION ALL
SELECT p.target_path AS path, s.file_name, s.p_partkey, s.p_name
FROM source s JOIN pairs p ON s.path = p.source_path WHERE p.target_path IS NOT NULL""",
    ),
    "replace_files_empty_source": Query(
        lambda s, d: _replacement(s, d, with_empty_file=True).targets,
        f"""{_REPLACE_SQL}, emptied AS (SELECT min(path) AS path FROM target WHERE file_name = 'PROMO')
SELECT * FROM target WHERE path NOT IN (SELECT target_path FROM pairs WHERE target_path IS NOT NULL)
  AND path NOT IN (SELECT path FROM emptied WHERE path IS NOT NULL)
UNION ALL
SELECT p.target_path AS path, s.file_name, s.p_partkey, s.p_name
FROM source s JOIN pairs p ON s.path = p.source_path WHERE p.target_path IS NOT NULL""",
    ),
    "replace_files_unmatched": Query(
        lambda s, d: _replacement(s, d).unmatched,
        f"{_REPLACE_SQL} SELECT file_name, source_path FROM pairs WHERE target_path IS NULL",
    ),
    "diff_tables": Query(
        lambda s, d: diff_tables(*_compared(s, d), row="p_partkey", max_diff_samples=50),
        f"{_DIFF_SQL} SELECT * FROM diffs ORDER BY row, col LIMIT 50",
    ),
    "diff_cells": Query(
        lambda s, d: diff_cells(*_compared(s, d), row="p_partkey"), f"{_DIFF_SQL} SELECT * FROM diffs"
    ),
}
