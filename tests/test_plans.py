"""The physical plans: what is shuffled, pushed down and split."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from keyweave.catalog.all_queries import QUERIES
from keyweave.operators.diff import diff_cells
from keyweave.operators.joins import inner_join_unique, left_join_unique, rows_absent_from
from keyweave.operators.rows import SyncColumns
from keyweave.operators.sync import sync_reverse, sync_single

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# Small tables stand for large ones: no broadcast, and a partition of 100 kB counts as large.
LARGE = {
    "spark__sql__autoBroadcastJoinThreshold": -1,
    "spark__sql__adaptive__autoBroadcastJoinThreshold": -1,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "100k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": 2,
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "50k",
    "spark__sql__shuffle__partitions": 16,
}


def skewed(spark, rows=60_000, distinct=3000):
    """A third of the rows has the key ``hot``, a third has none."""
    number = F.col("id") % distinct
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 2, F.concat(F.lit("k"), number.cast("string")))
    return spark.range(0, rows, 1, 8).select(
        F.lit("f").alias("file"),
        F.col("id").alias("row"),
        key.alias("key"),
        F.lit("M").alias("match"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )


COLUMNS = SyncColumns("key", "match", ("text",))


def test_a_hot_identity_is_split_in_forward_sync(spark):
    with settings(spark, **LARGE):
        targets, master = skewed(spark), skewed(spark, rows=6000)
        result = sync_single(targets, COLUMNS, master, COLUMNS, target_place=["file", "row"], master_order=["row"])
        result = result.select("row", "text", "cells_written")
        collected = result.collect()
        plan = plan_of(result).split("Initial Plan")[0]
    assert len(collected) == 60_000
    written = sum(r.cells_written for r in collected)
    known = {f"k{i % 3000}" for i in range(6000) if i % 3 == 2} | {"hot"}
    keys = ["hot" if i % 3 == 0 else f"k{i % 3000}" if i % 3 == 2 else None for i in range(60_000)]
    assert written == sum(k in known for k in keys)
    assert "skew=true" in plan
    # The large side is shuffled once.
    assert plan.count("Exchange hashpartitioning(_join_hash") == 2


def test_a_hot_master_identity_is_split_in_reverse_sync(spark):
    with settings(spark, **LARGE):
        result = sync_reverse(
            skewed(spark), COLUMNS, skewed(spark, rows=6000), COLUMNS, master_place=["row"], target_order=["row"]
        ).select("row", "text")
        assert len(result.collect()) == 60_000
        assert "skew=true" in plan_of(result)


@pytest.mark.parametrize("join", [inner_join_unique, rows_absent_from])
def test_other_joins_split_hot_groups_as_well(spark, join):
    with settings(spark, **LARGE):
        rows = skewed(spark).withColumn("g", F.coalesce("key", "text"))
        unique = skewed(spark, rows=3000).filter("key is not null").groupBy(F.col("key").alias("g")).agg(F.max("row").alias("m"))
        # "hot" has a partner: keep it for the inner join, take it out of the other.
        unique = unique if join is inner_join_unique else unique.filter("g <> 'hot'")
        result = join(rows, unique, ["g"])
        count = len(result.collect())
        assert "skew=true" in plan_of(result)
        known = {r.g for r in unique.collect()}
        matched = sum(r.g in known for r in rows.select("g").collect())
    assert count == (matched if join is inner_join_unique else 60_000 - matched)


def test_rows_without_identity_spread(spark):
    with settings(spark, **LARGE):
        rows = skewed(spark).filter("key is null")
        joined = left_join_unique(rows, skewed(spark, 3000).groupBy("key").agg(F.max("row").alias("m")), ["key"], ["file", "row"])
        with settings(spark, spark__sql__adaptive__enabled="false"):
            sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count("m")).collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_only_the_needed_columns_are_read(spark):
    result = QUERIES["sync_single_overwrite"].run(spark, FOLDER)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(result))
    assert schemas and not any("p_retailprice" in s or "l_extendedprice" in s for s in schemas)
    counts = result.groupBy("file").agg(F.sum("cells_written"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(counts))
    assert not any("l_linestatus" in s for s in schemas)


def test_version_and_file_filters_reach_the_scan(spark):
    targets = QUERIES["batch_forward"].run(spark, FOLDER)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_returnflag,A\)", plan_of(targets))


def test_small_sides_are_broadcast_by_size(spark):
    assert "BroadcastHashJoin" in plan_of(QUERIES["sync_single_overwrite"].run(spark, FOLDER))
    with settings(spark, **LARGE):
        assert "Broadcast" not in plan_of(QUERIES["sync_single_overwrite"].run(spark, FOLDER))


def test_comparing_tables_shuffles_each_once(spark):
    with settings(spark, **LARGE):
        left = spark.range(1000).select("id", *(F.col("id").alias(f"c{i}") for i in range(20)))
        plan = plan_of(diff_cells(left, left.withColumn("c3", F.col("c3") + 1), row="id"))
    # What else is exchanged are the differing blocks, counted and broadcast.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("BroadcastExchange") == 2
