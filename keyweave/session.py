"""Where intermediate tables are kept, and how a plan is cut into stages.

A stage that is read more than once, or that must not be computed twice with
different row positions, is written as a Parquet table under the folder the
session names in ``spark.checkpoint.dir``.  The table is on shared storage, so it
survives the loss of executors, and its real size is known to the planner, which
can then choose a broadcast join from a measured size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for intermediate tables; only a local master may go without one."""
    root = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CHECKPOINT_DIR} must name a shared folder on a cluster")
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_roots:
        _local_roots[app_id] = tempfile.mkdtemp(prefix="keyweave-")
    return _local_roots[app_id]


def intermediate_path(spark: SparkSession, label: str) -> str:
    app_id = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark)}/keyweave-{app_id}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Arrow batches for Python workers hold about ``most_bytes``, or one row, in what runs meanwhile.

    A batch lies several times over in the memory beside an executor's heap.  A smaller setting of the session holds.
    """
    before = spark.conf.get(_BATCH_BYTES)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(_BATCH_BYTES, str(min(now, most_bytes) if now > 0 else most_bytes))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def materialize(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as an intermediate table and read it back; ``batch_bytes`` is that of ``small_batches``."""
    spark = df.sparkSession
    path = intermediate_path(spark, label)
    with small_batches(spark, batch_bytes) if batch_bytes else nullcontext():
        df.write.mode("errorifexists").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._intermediate_path = path
    return table


def _delete(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release(*tables: DataFrame) -> None:
    """Delete intermediate tables as ``materialize`` gave them, once all that read them is written itself."""
    for table in tables:
        _delete(table.sparkSession, table._intermediate_path)


def drop_intermediates(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application, when none is needed any more."""
    return _delete(spark, f"{checkpoint_root(spark)}/keyweave-{spark.sparkContext.applicationId}")
