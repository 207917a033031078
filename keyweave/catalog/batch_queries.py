"""Batches: one forward job per line item file, and three cumulative reverse jobs.

One batch has a job that cannot run, and one has reverse jobs that write the match text, so that later jobs
meet the orders under another identity.
"""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.catalog import sync_queries as S
from keyweave.catalog.base import Query, sql_blank, sql_identity
from keyweave.plans.batch import FORWARD, REVERSE, BatchConfig, BatchJob, BatchRun, forward_jobs, reverse_jobs, run_batch

FILES = ("A", "N", "R")
_FORWARD_COLUMNS = ("name", "size", "name")
_REVERSE_COLUMNS = ("o_orderpriority", "o_note", "o_orderpriority")

FORWARD_CONFIG = BatchConfig(
    FORWARD,
    S.TARGET_ONE,
    "p_brand",
    "p_type",
    tuple(BatchJob(f, c, name=f"file {f}") for f, c in zip(FILES, _FORWARD_COLUMNS)),
    fill_blank_only=True,
)
REVERSE_CONFIG = BatchConfig(
    REVERSE,
    S.REVERSE_TARGET,
    "o_orderkey",
    "o_orderstatus",
    tuple(BatchJob(f, c, name=f"file {f}") for f, c in zip(FILES, _REVERSE_COLUMNS)),
)


#: The second job asks for a column that the master does not have.
_FAILING = replace(
    FORWARD_CONFIG,
    jobs=(FORWARD_CONFIG.jobs[0], replace(FORWARD_CONFIG.jobs[1], column=99), FORWARD_CONFIG.jobs[2]),
)
#: The second job writes the match text.
_REKEYING_COLUMNS = ("o_orderpriority", "o_orderstatus", "o_note", "o_orderpriority")
_REKEYING_FILES = ("A", "N", "R", "N")
_REKEYING = replace(
    REVERSE_CONFIG, jobs=tuple(BatchJob(f, c) for f, c in zip(_REKEYING_FILES, _REKEYING_COLUMNS))
)


def _by_file(rows: DataFrame) -> dict[str, DataFrame]:
    return {f: rows.filter(F.col("file") == f) for f in FILES}


def _forward(spark: SparkSession, folder: str, run, config: BatchConfig = FORWARD_CONFIG) -> DataFrame | BatchRun:
    return run(
        config,
        S.forward_master(spark, folder),
        _by_file(S.forward_targets(spark, folder).drop("size_text")),
        master_order=["p_partkey"],
        target_order=["file", *S.LINE],
    )


def _reverse(spark: SparkSession, folder: str, run=run_batch) -> DataFrame | BatchRun:
    return run(
        REVERSE_CONFIG,
        S.reverse_master(spark, folder).withColumn("o_note", F.lit(None).cast("string")),
        _by_file(S.reverse_targets(spark, folder)),
        master_order=["o_orderkey"],
        target_order=S.REVERSE_ORDER,
    )


def _restored(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as the first of three jobs left them, from what the later ones replaced."""
    run = _reverse(spark, folder, partial(run_batch, keep_changes=True))
    return run.before(2, ["o_orderkey"])


def _rekeyed(spark: SparkSession, folder: str) -> DataFrame:
    """Every line says whether the order is open or shipped, by its supplier."""
    status = F.when(F.col("l_suppkey") % 3 == 0, "O").when(F.col("l_suppkey") % 3 == 1, "F").otherwise("P")
    return run_batch(
        _REKEYING,
        S.reverse_master(spark, folder).withColumn("o_note", F.lit(None).cast("string")),
        _by_file(S.reverse_targets(spark, folder).withColumn("content", status)),
        master_order=["o_orderkey"],
        target_order=S.REVERSE_ORDER,
    ).master


_NEW = "CASE file WHEN 'N' THEN new_size ELSE new_name END"
_WRITE = f"({_NEW} IS NOT NULL AND NOT {sql_blank(_NEW)} AND {sql_blank('translation')})"
FORWARD_SQL = f"""{S.FORWARD_SQL}, batch AS (
  SELECT CASE file WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS job_index, file, l_orderkey, l_linenumber,
         l_partkey, l_suppkey, key, match, CASE WHEN {_WRITE} THEN {_NEW} ELSE translation END AS translation,
         CAST({_WRITE} AS BIGINT) AS cells_written
  FROM joined
)"""


def _reverse_sql(
    columns: tuple[str, ...] = _REVERSE_COLUMNS,
    files: tuple[str, ...] = FILES,
    content: str = "CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END",
) -> str:
    """One winner table and one master version per job; a row has the identity of its cells as they are then."""
    identity = sql_identity("CAST(o_orderkey AS VARCHAR)", "o_orderstatus")
    steps = f"""
WITH target AS (
  SELECT l_returnflag AS file, {sql_identity("CAST(l_orderkey AS VARCHAR)", "l_linestatus")} AS id,
         {content} AS content,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place
  FROM lineitem
), master0 AS (
  SELECT o_orderkey, o_orderstatus,
         CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderpriority END AS o_orderpriority,
         CAST(NULL AS VARCHAR) AS o_note, CAST(0 AS BIGINT) AS n
  FROM orders
)"""
    for i, (file, column) in enumerate(zip(files, columns), start=1):
        steps += f""", winner{i} AS (
  SELECT id, arg_max(content, place) AS new FROM target
  WHERE file = '{file}' AND id IS NOT NULL AND NOT {sql_blank("content")} GROUP BY id
), master{i} AS (
  SELECT m.* REPLACE (coalesce(new, {column}) AS {column}, CAST(new IS NOT NULL AS BIGINT) AS n)
  FROM master{i - 1} m LEFT JOIN winner{i} w ON w.id = {identity}
)"""
    return steps


REVERSE_SQL = _reverse_sql()


def _summary_sql(mode: str, updated: str) -> str:
    return f"""SELECT '{mode}' AS mode, CAST(3 AS BIGINT) AS jobs_total, CAST(3 AS BIGINT) AS jobs_succeeded,
       CAST(0 AS BIGINT) AS jobs_failed, CAST({updated} AS BIGINT) AS updated_total, FALSE AS stopped_early"""


QUERIES = {
    "batch_forward": Query(
        lambda s, d: _forward(s, d, forward_jobs).drop("l_shipdate"), f"{FORWARD_SQL} SELECT * FROM batch"
    ),
    "batch_forward_results": Query(
        lambda s, d: _forward(s, d, run_batch).results_table().drop("elapsed_ms"),
        f"""{FORWARD_SQL}
SELECT job_index, 'file ' || file AS job_name, 'success' AS status,
       CAST(sum(cells_written) AS BIGINT) AS updated_count, '' AS error FROM batch GROUP BY 1, 2""",
    ),
    "batch_reverse": Query(
        lambda s, d: _reverse(s, d).master,
        f"{REVERSE_SQL} SELECT o_orderkey, o_orderstatus, o_orderpriority, o_note FROM master3",
    ),
    "batch_reverse_one_plan": Query(
        lambda s, d: _reverse(s, d, reverse_jobs),
        f"""{REVERSE_SQL}
SELECT o_orderkey, m3.o_orderstatus, m3.o_orderpriority, m3.o_note, m1.n + m2.n + m3.n AS cells_written
FROM master3 m3 JOIN master2 m2 USING (o_orderkey) JOIN master1 m1 USING (o_orderkey)""",
    ),
    "batch_reverse_summary": Query(
        lambda s, d: _reverse(s, d).summary_table(),
        f"""{REVERSE_SQL}
{_summary_sql(REVERSE, "(SELECT sum(n) FROM master1) + (SELECT sum(n) FROM master2) + (SELECT sum(n) FROM master3)")}""",
    ),
    "batch_results_with_failure": Query(
        lambda s, d: _forward(s, d, run_batch, _FAILING).results_table().drop("elapsed_ms"),
        f"""{FORWARD_SQL}
SELECT job_index, 'file ' || file AS job_name, CASE job_index WHEN 2 THEN 'failed' ELSE 'success' END AS status,
       CAST(CASE job_index WHEN 2 THEN 0 ELSE sum(cells_written) END AS BIGINT) AS updated_count,
       CASE job_index WHEN 2 THEN 'the master has no column 99' ELSE '' END AS error FROM batch GROUP BY 1, file""",
    ),
    "batch_stopped_early": Query(
        lambda s, d: _forward(s, d, run_batch, replace(_FAILING, continue_on_error=False)).summary_table(),
        f"""{FORWARD_SQL}
SELECT '{FORWARD}' AS mode, CAST(3 AS BIGINT) AS jobs_total, CAST(1 AS BIGINT) AS jobs_succeeded,
       CAST(1 AS BIGINT) AS jobs_failed, CAST(sum(cells_written) AS BIGINT) AS updated_total, TRUE AS stopped_early
FROM batch WHERE job_index = 1""",
    ),
    "master_restored": Query(
        _restored, f"{REVERSE_SQL} SELECT o_orderkey, o_orderstatus, o_orderpriority, o_note FROM master1"
    ),
    "batch_reverse_rekeyed": Query(
        _rekeyed,
        f"""{_reverse_sql(_REKEYING_COLUMNS, _REKEYING_FILES,
                          "CASE l_suppkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END")}
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_note FROM master4""",
    ),
}
