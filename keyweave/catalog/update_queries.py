"""The master update suite.

Master: ``part`` with the Brand#1 family under old names, with brand as key, type as match text, and name,
size and supplier as cells.  Sources: all of ``lineitem`` with the brand and type of its part,
one file per return flag; names are blank on open lines and some match texts are missing, so
each identity has many source rows and the Brand#1 family is new to the master.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.catalog.base import Query, sql_blank, sql_changed, sql_identity, sql_key_identity, sql_strip, table
from keyweave.catalog.sync_queries import LINE
from keyweave.functions.winners import first_cells
from keyweave.operators import update as U
from keyweave.operators.rows import COMBINED_KEY, ID, KEY_ONLY, resolve_layout, source_cells
from keyweave.plans.master_update import (
    ALLOW_NEW_KEY,
    EXISTING_KEY_ONLY,
    FILL_BLANK_ONLY,
    OVERWRITE_NON_BLANK,
    MasterUpdate,
    UpdatePolicies,
    source_then_translation,
    update_master_table,
)

CELLS = ["brand", "type", "name", "size", "supplier"]
LAYOUT = resolve_layout(CELLS, "brand", "type")
ORDER = ["file", *LINE]
WHERE = {"row": "row_nr", "order": ORDER, "file": "file"}


def master(spark: SparkSession, folder: str) -> DataFrame:
    renamed = F.when(F.col("p_brand").startswith("Brand#1"), F.concat(F.lit("Old "), "p_brand"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_nr"),
        renamed.otherwise(F.col("p_brand")).alias("brand"),
        F.col("p_type").alias("type"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("name"),
        F.col("p_size").cast("string").alias("size"),
        F.lit("").alias("supplier"),
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_returnflag").alias("file"),
        *LINE,
        F.col("p_brand").alias("brand"),
        F.when(F.col("l_discount") != 0, F.concat(F.lit(" "), "p_type")).otherwise(F.lit(" ")).alias("type"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("l_linenumber") < 4, F.col("p_size").cast("string")).alias("size"),
        F.col("l_suppkey").alias("supplier"),
    )


BASE_SQL = f"""
WITH master0 AS (
  SELECT p_partkey AS row_nr,
         CASE WHEN p_brand LIKE 'Brand#1%' THEN 'Old ' || p_brand ELSE p_brand END AS brand, p_type AS type,
         CASE WHEN p_size % 7 <> 0 THEN p_name END AS name,
         CAST(p_size AS VARCHAR) AS size, '' AS supplier
  FROM part
), source0 AS (
  SELECT l_returnflag AS file,
         row(l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place,
         p_brand AS brand,
         CASE WHEN l_discount <> 0 THEN ' ' || p_type ELSE ' ' END AS type,
         CASE WHEN l_linestatus = 'O' THEN '' ELSE p_name END AS name,
         coalesce(CASE WHEN l_linenumber < 4 THEN CAST(p_size AS VARCHAR) END, '') AS size,
         CAST(l_suppkey AS VARCHAR) AS supplier
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

# The combined identity: both parts are stripped.
COMBINED_SQL = f"""{BASE_SQL}, master AS (
  SELECT *, {sql_identity("brand", "type")} AS id FROM master0
), source AS (
  SELECT * REPLACE ({sql_strip("brand")} AS brand, {sql_strip("type")} AS type),
         {sql_identity("brand", "type")} AS id
  FROM source0 WHERE {sql_identity("brand", "type")} IS NOT NULL
)"""

# The key alone: the match text is content and stays as it is.
KEY_SQL = f"""{BASE_SQL}, master AS (
  SELECT *, {sql_key_identity("brand")} AS id FROM master0
), source AS (
  SELECT * REPLACE ({sql_strip("brand")} AS brand), {sql_key_identity("brand")} AS id
  FROM source0 WHERE {sql_key_identity("brand")} IS NOT NULL
)"""


def _policies(cell: str, key: str, row_key: str = COMBINED_KEY) -> UpdatePolicies:
    return UpdatePolicies(cell_write_policy=cell, key_admission_policy=key, row_key_policy=row_key)


MERGE = _policies(FILL_BLANK_ONLY, ALLOW_NEW_KEY)
MERGE_KEY_ONLY = _policies(FILL_BLANK_ONLY, ALLOW_NEW_KEY, KEY_ONLY)
DENSE = _policies(OVERWRITE_NON_BLANK, ALLOW_NEW_KEY)
SPARSE = _policies(OVERWRITE_NON_BLANK, EXISTING_KEY_ONLY)


def run(spark: SparkSession, folder: str, policies: UpdatePolicies, **more) -> MasterUpdate:
    return update_master_table(master(spark, folder), sources(spark, folder), LAYOUT, policies, **WHERE, **more)


def _counted_files(spark: SparkSession, folder: str) -> DataFrame:
    """The counters with a list of files, one of which has no row."""
    files = sources(spark, folder).select("file").distinct()
    return run(spark, folder, MERGE, files=files.union(spark.range(1).select(F.lit("empty")))).counters


def _row_of(cells: list[str], pick: str) -> str:
    return ", ".join(f"{pick}({c}, place) AS {c}" for c in cells)


def _appended(candidates: str) -> str:
    return f"""SELECT (SELECT max(row_nr) FROM master) + row_number() OVER (ORDER BY seen) AS row_nr,
         brand, type, name, size, supplier
  FROM {candidates} c WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.id = c.id)"""


def _merge_sql(base: str, where: str = "TRUE") -> str:
    return f"""{base}, cand AS (
  SELECT id, {_row_of(CELLS, "arg_min")}, min(place) AS seen FROM source WHERE {where} GROUP BY id
), added AS ({_appended("cand")})
"""


_ALL = "row_nr, brand, type, name, size, supplier"
_MATCHED = f"NOT {sql_blank('type')}"

DENSE_BASE = f"""{KEY_SQL}, cand AS (
  SELECT id, {_row_of(CELLS, "arg_max")}, min(place) AS seen FROM source GROUP BY id
), added AS ({_appended("cand")})"""


def _overwrite_sql(content: list[str]) -> str:
    cells = ", ".join(
        f"CASE WHEN {sql_changed(f'm.{c}', f'c.{c}')} THEN c.{c} ELSE m.{c} END AS {c}" for c in content
    )

    def total(test: str) -> str:
        return " + ".join(
            f"CAST({test.format(ch=sql_changed(f'm.{c}', f'c.{c}'), old=sql_blank(f'm.{c}'), new=sql_blank(f'c.{c}'))} AS BIGINT)"
            for c in content
        )

    return f"""SELECT m.row_nr, m.id, m.brand{', m.type' if 'type' not in content else ''}, {cells},
         {total("({ch})")} AS n_updated,
         {total("({ch} AND {old} AND NOT {new})")} AS n_filled,
         {total("({ch} AND NOT {old} AND NOT {new})")} AS n_overwritten
  FROM master m LEFT JOIN cand c ON m.id = c.id"""


DENSE_SQL = f"""{DENSE_BASE}, planned AS ({_overwrite_sql(["type", "name", "size", "supplier"])})"""


def _last_non_blank(c: str) -> str:
    return f"arg_max({c}, place) FILTER (WHERE NOT {sql_blank(c)})"


_TOUCHED = f"(NOT {sql_blank('name')} OR NOT {sql_blank('size')} OR NOT {sql_blank('supplier')})"
_ORIGIN = "{'file': file, 'key': brand, 'match': type}"

SPARSE_SQL = f"""{COMBINED_SQL}, cand AS (
  SELECT id, {', '.join(f"{_last_non_blank(c)} AS {c}" for c in ("name", "size", "supplier"))},
         coalesce(arg_max({_ORIGIN}, place) FILTER (WHERE {_TOUCHED}), arg_min({_ORIGIN}, place)) AS origin
  FROM source GROUP BY id
), planned AS ({_overwrite_sql(["name", "size", "supplier"])}
), unknown AS (
  SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.id = c.id)
)"""


def _counter_sql(base: str, added: str, unmatched: str, planned: bool = True) -> str:
    def cell(name: str) -> str:
        return f"(SELECT CAST(sum({name}) AS BIGINT) FROM planned)" if planned else "CAST(0 AS BIGINT)"

    return f"""{base}
SELECT {cell("n_updated")} AS updated_cells,
       CAST({added} AS BIGINT) AS added_rows,
       CAST((SELECT count(DISTINCT id) FROM master) + {added} AS BIGINT) AS merged_keys,
       CAST((SELECT count(DISTINCT file) FROM source0) AS BIGINT) AS source_files,
       {cell("n_overwritten")} AS overwritten_cells,
       {cell("n_filled")} AS filled_blank_cells,
       CAST({unmatched} AS BIGINT) AS skipped_new_keys,
       CAST({unmatched} AS BIGINT) AS unmatched_entries"""


def _two_stages(spark: SparkSession, folder: str) -> tuple[MasterUpdate, MasterUpdate]:
    rows = sources(spark, folder)
    return source_then_translation(
        master(spark, folder),
        rows.filter(F.col("file") == "A"),
        rows.filter(F.col("file") != "A"),
        LAYOUT,
        **WHERE,
    )


# Dense update with file A by key, then a sparse update with files N and R by key and match.
TWO_STAGE_SQL = f"""{BASE_SQL}, master AS (
  SELECT *, {sql_key_identity("brand")} AS id FROM master0
), source AS (
  SELECT * REPLACE ({sql_strip("brand")} AS brand), {sql_key_identity("brand")} AS id
  FROM source0 WHERE file = 'A' AND {sql_key_identity("brand")} IS NOT NULL
), cand AS (
  SELECT id, {_row_of(CELLS, "arg_max")}, min(place) AS seen FROM source GROUP BY id
), added AS ({_appended("cand")}
), stage AS (
  SELECT {_ALL} FROM ({_overwrite_sql(["type", "name", "size", "supplier"])})
  UNION ALL SELECT {_ALL} FROM added
), stage_id AS (
  SELECT *, {sql_identity("brand", "type")} AS id FROM stage
), source2 AS (
  SELECT *, {sql_identity("brand", "type")} AS id
  FROM source0 WHERE file <> 'A' AND {sql_identity("brand", "type")} IS NOT NULL
), cand2 AS (
  SELECT id, {', '.join(f"{_last_non_blank(c)} AS {c}" for c in ("name", "size", "supplier"))}
  FROM source2 GROUP BY id
)
SELECT {_ALL} FROM ({_overwrite_sql(["name", "size", "supplier"]).replace("FROM master m", "FROM stage_id m").replace("JOIN cand c", "JOIN cand2 c")})"""


def _first_cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = source_cells(sources(spark, folder), LAYOUT, COMBINED_KEY, ORDER)
    return first_cells(rows, ID, ["name", "size", "supplier"], ORDER).withColumnRenamed(ID, "identity")


QUERIES = {
    "merge_masters_combined": Query(
        lambda s, d: run(s, d, MERGE).master,
        f"{_merge_sql(COMBINED_SQL)} SELECT {_ALL} FROM master UNION ALL SELECT {_ALL} FROM added",
    ),
    "merge_masters_key_only": Query(
        lambda s, d: run(s, d, MERGE_KEY_ONLY).master,
        f"{_merge_sql(KEY_SQL, _MATCHED)} SELECT {_ALL} FROM master UNION ALL SELECT {_ALL} FROM added",
    ),
    "update_master_dense": Query(
        lambda s, d: run(s, d, DENSE).master,
        f"{DENSE_SQL} SELECT {_ALL} FROM planned UNION ALL SELECT {_ALL} FROM added",
    ),
    "update_content_sparse": Query(lambda s, d: run(s, d, SPARSE).master, f"{SPARSE_SQL} SELECT {_ALL} FROM planned"),
    "merge_counters": Query(
        lambda s, d: run(s, d, MERGE).counters,
        _counter_sql(_merge_sql(COMBINED_SQL), "(SELECT count(*) FROM added)", "0", planned=False),
    ),
    "source_files_counted": Query(
        _counted_files,
        _counter_sql(_merge_sql(COMBINED_SQL), "(SELECT count(*) FROM added)", "0", planned=False).replace(
            "count(DISTINCT file) FROM source0", "count(DISTINCT file) + 1 FROM source0"
        ),
    ),
    "update_counters_dense": Query(
        lambda s, d: run(s, d, DENSE).counters,
        _counter_sql(DENSE_SQL, "(SELECT count(*) FROM added)", "0"),
    ),
    "update_counters_sparse": Query(
        lambda s, d: run(s, d, SPARSE).counters,
        _counter_sql(SPARSE_SQL, "0", "(SELECT count(*) FROM unknown)"),
    ),
    "update_rows_scanned": Query(
        lambda s, d: run(s, d, SPARSE).scan_counters,
        f"""{BASE_SQL}
SELECT count(DISTINCT file) AS source_files, count(*) AS rows_scanned,
       count(*) FILTER (WHERE {sql_identity("brand", "type")} IS NULL) AS rows_without_identity FROM source0""",
    ),
    "merge_rows_scanned_key_only": Query(
        lambda s, d: run(s, d, MERGE_KEY_ONLY).scan_counters,
        f"""{BASE_SQL}
SELECT count(DISTINCT file) AS source_files, count(*) AS rows_scanned,
       count(*) FILTER (WHERE {sql_key_identity("brand")} IS NULL) AS rows_without_identity FROM source0""",
    ),
    "unmatched_report": Query(
        lambda s, d: run(s, d, SPARSE).unmatched,
        f"""{SPARSE_SQL}
SELECT origin.key AS key, origin.match AS match, origin.file AS source_file,
       name AS content_col_3, size AS content_col_4, supplier AS content_col_5
FROM unknown""",
    ),
    "source_then_translation": Query(lambda s, d: _two_stages(s, d)[1].master, TWO_STAGE_SQL),
    "first_non_blank_cells": Query(
        _first_cells,
        f"""{COMBINED_SQL}
SELECT id AS identity, {', '.join(f"arg_min({c}, place) FILTER (WHERE NOT {sql_blank(c)}) AS {c}" for c in ("name", "size", "supplier"))}
FROM source GROUP BY id""",
    ),
}
