"""Forward and reverse sync.

Master: ``part``, identified by brand and type, many parts per identity, the last part
number wins; its name is blank for some sizes.  Targets: ``lineitem`` with the brand and type
of its part, one file per return flag; keys carry outer white space, some rows have no match
text, and open lines are untranslated.
Reverse: ``lineitem`` files by return flag give supplier numbers to ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.catalog.base import Query, sql_blank, sql_identity, table
from keyweave.operators.rows import SyncColumns
from keyweave.operators.sync import sync_multi, sync_reverse, sync_single, written_by_file

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def forward_master(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        "p_brand",
        "p_type",
        F.when(F.col("p_size") % 7 == 0, "  ").otherwise(F.col("p_name")).alias("name"),
        F.col("p_size").alias("size"),
    )


def forward_targets(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_returnflag").alias("file"),
        *LINE,
        F.concat(F.lit("\u00a0"), "p_brand", F.lit(" ")).alias("key"),
        F.when(F.col("l_discount") != 0, F.col("p_type")).alias("match"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")).alias("translation"),
        F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_linestatus")).alias("size_text"),
    )


FORWARD_SQL = f"""
WITH master AS (
  SELECT p_partkey, {sql_identity("p_brand", "p_type")} AS id,
         CASE WHEN p_size % 7 = 0 THEN '  ' ELSE p_name END AS name,
         CAST(p_size AS VARCHAR) AS size
  FROM part
), idx AS (
  SELECT id, arg_max(name, p_partkey) AS name, arg_max(size, p_partkey) AS size
  FROM master WHERE id IS NOT NULL GROUP BY id
), base AS (
  SELECT l_returnflag AS file, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         chr(160) || p_brand || ' ' AS key,
         CASE WHEN l_discount <> 0 THEN p_type END AS match,
         CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS translation,
         CASE WHEN l_linestatus = 'F' THEN '' ELSE l_linestatus END AS size_text
  FROM lineitem JOIN part ON l_partkey = p_partkey
), target AS (
  SELECT *, {sql_identity("key", "match")} AS id FROM base
), joined AS (
  SELECT t.*, m.name AS new_name, m.size AS new_size FROM target t LEFT JOIN idx m USING (id)
)
"""


def _forward_sql(columns: dict[str, str], fill_blank_only: bool, allow_blank_write: bool) -> str:
    tests = {}
    for target, new in columns.items():
        test = f"{new} IS NOT NULL"
        if not allow_blank_write:
            test += f" AND NOT {sql_blank(new)}"
        if fill_blank_only:
            test += f" AND {sql_blank(target)}"
        tests[target] = test
    cells = ", ".join(f"CASE WHEN {tests[c]} THEN {new} ELSE {c} END AS {c}" for c, new in columns.items())
    written = " + ".join(f"CAST(({t}) AS BIGINT)" for t in tests.values())
    return f"""{FORWARD_SQL}
SELECT file, l_orderkey, l_linenumber, l_partkey, l_suppkey, key, match, {cells},
       CAST({written} AS BIGINT) AS cells_written
FROM joined"""


MASTER_ONE = SyncColumns("p_brand", "p_type", ("name",))
MASTER_TWO = SyncColumns("p_brand", "p_type", ("name", "size"))
TARGET_ONE = SyncColumns("key", "match", ("translation",))
TARGET_TWO = SyncColumns("key", "match", ("translation", "size_text"))


def forward_single(spark: SparkSession, folder: str, **flags: bool) -> DataFrame:
    return sync_single(
        forward_targets(spark, folder).drop("size_text"),
        TARGET_ONE,
        forward_master(spark, folder),
        MASTER_ONE,
        target_place=["file", *LINE],
        master_order=["p_partkey"],
        **flags,
    ).drop("l_shipdate")


def _multi(spark: SparkSession, folder: str, **flags: bool) -> DataFrame:
    return sync_multi(
        forward_targets(spark, folder),
        TARGET_TWO,
        forward_master(spark, folder),
        MASTER_TWO,
        target_place=["file", *LINE],
        master_order=["p_partkey"],
        **flags,
    ).drop("l_shipdate")


def reverse_targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("file"),
        *LINE,
        "l_linestatus",
        F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("content"),
    )


def reverse_master(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("o_orderpriority"),
    )


REVERSE_SOURCE = SyncColumns("o_orderkey", "o_orderstatus", ("o_orderpriority",))
REVERSE_TARGET = SyncColumns("l_orderkey", "l_linestatus", ("content",))
REVERSE_ORDER = ["file", *LINE]


def _reverse(spark: SparkSession, folder: str, **flags: bool) -> DataFrame:
    return sync_reverse(
        reverse_master(spark, folder),
        REVERSE_SOURCE,
        reverse_targets(spark, folder),
        REVERSE_TARGET,
        master_place=["o_orderkey"],
        target_order=REVERSE_ORDER,
        **flags,
    )


def reverse_sql(fill_blank_only: bool, allow_blank_write: bool) -> str:
    keep = "" if allow_blank_write else f"AND NOT {sql_blank('content')}"
    fill = f"AND {sql_blank('old')}" if fill_blank_only else ""
    return f"""
WITH target AS (
  SELECT {sql_identity("CAST(l_orderkey AS VARCHAR)", "l_linestatus")} AS id,
         CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS content,
         row(l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place
  FROM lineitem
), winner AS (
  SELECT id, arg_max(content, place) AS new FROM target
  WHERE id IS NOT NULL {keep} GROUP BY id
), master AS (
  SELECT o_orderkey, o_orderstatus,
         CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderpriority END AS old,
         {sql_identity("CAST(o_orderkey AS VARCHAR)", "o_orderstatus")} AS id
  FROM orders
)
SELECT o_orderkey, o_orderstatus,
       CASE WHEN new IS NOT NULL {fill} THEN new ELSE old END AS o_orderpriority,
       CAST((new IS NOT NULL {fill}) AS BIGINT) AS cells_written
FROM master LEFT JOIN winner USING (id)"""


_NAME = {"translation": "new_name"}
_BOTH = {"translation": "new_name", "size_text": "new_size"}

QUERIES = {
    "sync_single_overwrite": Query(forward_single, _forward_sql(_NAME, False, False)),
    "sync_single_fill_blank": Query(
        lambda s, d: forward_single(s, d, fill_blank_only=True), _forward_sql(_NAME, True, False)
    ),
    "sync_single_allow_blank": Query(
        lambda s, d: forward_single(s, d, allow_blank_write=True), _forward_sql(_NAME, False, True)
    ),
    "sync_multi_overwrite": Query(_multi, _forward_sql(_BOTH, False, False)),
    "sync_multi_fill_blank": Query(
        lambda s, d: _multi(s, d, fill_blank_only=True), _forward_sql(_BOTH, True, False)
    ),
    "sync_written_by_file": Query(
        lambda s, d: written_by_file(forward_single(s, d, fill_blank_only=True), "file"),
        f"""SELECT file, CAST(sum(cells_written) AS BIGINT) AS cells_written
FROM ({_forward_sql(_NAME, True, False)}) GROUP BY file""",
    ),
    "sync_reverse_overwrite": Query(_reverse, reverse_sql(False, False)),
    "sync_reverse_fill_blank": Query(
        lambda s, d: _reverse(s, d, fill_blank_only=True), reverse_sql(True, False)
    ),
    "sync_reverse_allow_blank": Query(
        lambda s, d: _reverse(s, d, allow_blank_write=True), reverse_sql(False, True)
    ),
}
