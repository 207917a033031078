"""Files replaced one by one: each on its own, in a task, and with a log of what happened.

An exchange puts new content into the place of a file.  The content is copied beside the file first, the old
file is renamed, the new one is renamed into its place, and only then the old one goes.  What fails concerns one
file: it keeps its old content and gets a row in the log that says in which stage it failed.

A task may run twice, because an executor was lost.  The second run finds the old file beside the place, and
either puts it back or finishes.  An exchange of equal content does nothing, so repeating a whole run is safe.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.operators.joins import inner_join_unique
from keyweave.operators.sync import WRITTEN
from keyweave.session import _delete, intermediate_path, materialize
from keyweave.sources.readers import _dealt, _opened, _same_form

REPLACED, UNCHANGED, FAILED = "replaced", "unchanged", "failed"
#: The stages of an exchange: reading the new content, copying it, renaming.
LOAD, WRITE, SAVE = "load", "write", "save"
LOG = "path string, source string, status string, stage string, message string"
E_TARGET_SAVE = "E_TARGET_SAVE"
_BLOCK = 1 << 20
#: Rows that are read at once when files are put together, and bytes of a row group.
_BLOCK_ROWS, _GROUP_BYTES = 1024, 32 << 20
#: Rows that one task sorts, about, where the session has fewer shuffle partitions than that takes.
_RANGE_ROWS = 500_000


def _exists(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type == fs.FileType.File


def _blocks(system, path: str) -> Iterator[bytes]:
    with system.open_input_stream(path) as stream:
        while block := stream.read(_BLOCK):
            yield block


def _equal(one: tuple, other: tuple) -> bool:
    """Whether two files, each a file system and a path, have the same bytes."""
    if one[0].get_file_info(one[1]).size != other[0].get_file_info(other[1]).size:
        return False
    return all(a == b for a, b in zip(_blocks(*one), _blocks(*other), strict=True))


def _exchange(target: str, source: str) -> tuple[str, str | None, str | None]:
    """Status, stage and message of one exchange."""
    stage, begun = LOAD, False
    system = new = None
    try:
        system, place = _opened(target)
        new_system, new_place = _opened(source)
        new_system.open_input_stream(new_place).close()
        new, old = f"{place}.new", f"{place}.bak"
        if _exists(system, old):  # an earlier run of this task ended on its way
            begun = _exists(system, place)
            if begun:
                system.delete_file(old)
            else:
                system.move(old, place)
        there = _exists(system, place)
        if there and _equal((system, place), (new_system, new_place)):
            return (REPLACED if begun else UNCHANGED), None, None
        stage = WRITE
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(new) as out:
            for block in _blocks(new_system, new_place):
                out.write(block)
        stage = SAVE
        if there:
            system.move(place, old)
        try:
            system.move(new, place)
        except Exception:
            if there:
                system.move(old, place)
            raise
        if there:
            system.delete_file(old)
        return REPLACED, None, None
    except Exception as failure:  # noqa: BLE001 - any failure of a file is a row of the log
        try:
            if new and _exists(system, new):
                system.delete_file(new)
        except Exception:  # noqa: BLE001 - the first failure is the one to report
            pass
        return FAILED, stage, f"{type(failure).__name__}: {failure}"


def exchange_files(pairs: DataFrame, label: str = "exchange") -> DataFrame:
    """Put each file ``source`` into the place ``path``; the log of all, a written table.

    A path may occur once; its folders are made if they are missing.  The pairs are dealt to as many tasks as the session has shuffle partitions.
    """

    def exchanged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, source, *_exchange(path, source)) for path, source in zip(batch["path"], batch["source"])]
            yield pd.DataFrame(rows, columns=["path", "source", "status", "stage", "message"])

    # Written before it is dealt out, so that no exchange reads what another one changes.
    listed = materialize(pairs.select("path", "source"), f"{label}-pairs")
    return materialize(_dealt(listed).mapInPandas(exchanged, LOG), label)


def errors_of(log: DataFrame, code: str) -> DataFrame:
    """The failed exchanges as error rows: code, path, file_name, message, stage."""
    return log.where(F.col("status") == FAILED).select(
        F.lit(code).alias("code"),
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "message",
        "stage",
    )


def _blocks_of(pieces: Sequence[str]):
    """The schema of Parquet files, and their rows in blocks of equal length, however many files they come from."""
    import pyarrow as pa
    from pyarrow import parquet

    def opened(piece: str, handles: ExitStack):
        system, place = _opened(piece)
        handle = handles.enter_context(system.open_input_file(place))
        return parquet.ParquetFile(handle, coerce_int96_timestamp_unit="us")

    def blocks():
        held = []
        for piece in pieces:
            with ExitStack() as handles:
                for batch in opened(piece, handles).iter_batches(_BLOCK_ROWS):
                    rows = pa.Table.from_batches([*held, batch])
                    if rows.num_rows >= _BLOCK_ROWS:
                        yield rows.slice(0, _BLOCK_ROWS)
                        rows = rows.slice(_BLOCK_ROWS)
                    held = rows.to_batches()
        if held:
            yield pa.Table.from_batches(held)

    with ExitStack() as handles:
        first = opened(pieces[0], handles)
        codec = first.metadata.row_group(0).column(0).compression if first.metadata.num_columns else "NONE"
        return first.schema_arrow, codec, blocks()


def _size(block) -> int:
    """Bytes of a block, about; the same however its rows were held before."""
    import pyarrow as pa
    from pyarrow import compute

    texts = [c for c in block.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    lists = [c.nbytes for c in block.columns if pa.types.is_nested(c.type)]
    return sum(compute.sum(compute.binary_length(c)).as_py() or 0 for c in texts) + 8 * block.num_rows * block.num_columns + sum(lists)


def _in_utc(arrow, kind: T.DataType):
    """The Arrow type in which Spark's timestamps keep their meaning: those of 96 bits are read without a time zone."""
    import pyarrow as pa

    if isinstance(kind, T.TimestampType):
        return pa.timestamp("us", "UTC")
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow.value_field.with_type(_in_utc(arrow.value_type, kind.elementType)))
    if isinstance(kind, T.MapType):
        key, item = _in_utc(arrow.key_type, kind.keyType), _in_utc(arrow.item_type, kind.valueType)
        return pa.map_(arrow.key_field.with_type(key), arrow.item_field.with_type(item))
    if isinstance(kind, T.StructType):
        return pa.struct([f.with_type(_in_utc(f.type, k.dataType)) for f, k in zip(arrow, kind, strict=True)])
    return arrow


def _put_together(pieces: Sequence[str], path: str, kind: T.StructType) -> None:
    """Write the rows of Parquet files, in the order of the files, as one file; equal rows give equal bytes."""
    import pyarrow as pa
    from pyarrow import parquet

    found, codec, blocks = _blocks_of(pieces)
    fields = [f.with_type(_in_utc(f.type, kind[f.name].dataType)) for f in found]
    schema = pa.schema(fields, found.metadata)
    system, place = _opened(path)
    codecs = {"UNCOMPRESSED": "NONE", "LZ4_RAW": "LZ4"}
    with (
        system.open_output_stream(place) as out,
        parquet.ParquetWriter(out, schema, compression=codecs.get(codec, codec), store_schema=False) as writer,
    ):

        def put(group: list) -> None:
            rows = pa.concat_tables(group).cast(schema).combine_chunks()
            writer.write_table(rows, row_group_size=max(1, rows.num_rows))

        group, size = [], 0
        for block in blocks:
            group.append(block)
            size += _size(block)
            if size >= _GROUP_BYTES:
                put(group)
                group, size = [], 0
        if group:
            put(group)


def _one_file_each(
    rows: DataFrame, files: DataFrame, n: int, file: str, row: Sequence[str], drop: Sequence[str] = ()
) -> DataFrame:
    """Write every file of the ``n`` ``rows``, listed in ``files``, as one Parquet file; (path, source).

    The rows are dealt by ranges and sorted there, so a large file is the work of many tasks and comes in pieces.  One
    task puts the pieces of a file together in their order and holds one row group of them.
    """
    spark = rows.sparkSession
    pieces = intermediate_path(spark, "pieces")
    kept = [c for c in rows.columns if c != file and c not in drop]
    kind = rows.select(*(F.col(f"`{c}`") for c in kept)).schema
    # Paths may be longer than a folder name can be, so a hash names the folder of a file.
    place = F.hex(F.xxhash64(file)).alias("place")
    order = ["_place", file, *row]
    ranges = -(-n // _RANGE_ROWS)
    many = [ranges] if ranges > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    named = rows.withColumn("_place", place).repartitionByRange(*many, *order).sortWithinPartitions(*order)
    named.select(*(F.col(f"`{c}`") for c in kept), "_place").write.partitionBy("_place").parquet(pieces)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(pieces)
    listed = listed.select(F.regexp_extract("path", "/_place=([0-9A-F]+)/", 1).alias("place"), _same_form(F.col("path")).alias("piece"))
    # A piece per range at most; their names are in the order of the ranges.
    listed = listed.groupBy("place").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    asked = files.select(F.col(file).alias("path"), place).join(listed, "place").select("path", "place", "pieces")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, name, parts in zip(batch["path"], batch["place"], batch["pieces"], strict=True):
                folder = parts[0].rsplit("/_place=", 1)[0] + "-joined"
                _opened(folder)[0].create_dir(_opened(folder)[1], recursive=True)
                source = f"{folder}/{name}-{uuid.uuid4().hex}.parquet"  # a task that runs twice writes two
                _put_together(list(parts), source, kind)
                found.append((path, source))
            yield pd.DataFrame(found, columns=["path", "source"])

    pairs = materialize(_dealt(asked).mapInPandas(joined, "path string, source string"), "joined-files")
    _delete(spark, pieces)
    return pairs


def write_files(rows: DataFrame, *, file: str, row: Sequence[str]) -> DataFrame:
    """Write ``rows`` as one Parquet file per path in ``file``, in the order of ``row``; the log of the files.

    A file that is there is exchanged, one that is not gets its folders.  ``file`` is no column of the files.
    """
    rows = materialize(rows, "files")
    return exchange_files(_one_file_each(rows, rows.select(file).distinct(), rows.count(), file, row), "written-files")


def commit_changed_files(
    targets: DataFrame,
    synced: Callable[[DataFrame], DataFrame],
    *,
    file: str,
    row: str,
    service: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Rewrite the files of ``targets`` in which ``synced`` writes a cell, each on its own; (file, cells written) and the log.

    ``synced`` maps rows of the targets to the same rows with ``cells_written``.  A first pass counts the writes per file, from
    the columns it needs; the second one takes the rows of the changed files only, before they are synced.  ``file``
    holds the paths of Parquet files, ``row`` the order of the rows; columns in ``service`` are not written.  A file is
    one file again: many tasks sort its rows, one puts them together as a stream.
    """
    counted = materialize(_changed(synced(targets), file), "changed-files")
    changed = counted.select(file, WRITTEN)
    n = counted.agg(F.sum("_rows")).first()[0]
    if n is None:
        return changed, targets.sparkSession.createDataFrame([], LOG)
    rows = synced(inner_join_unique(targets, changed.select(file), [file]))
    pairs = _one_file_each(rows.drop(WRITTEN), changed, n, file, [row], service)
    return changed, exchange_files(pairs, "committed-files")


def commit_written_rows(
    rows: DataFrame, *, file: str, row: str, service: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The same for a stored result: exchange the files in which ``rows`` counts a written cell."""
    return commit_changed_files(rows, lambda some: some, file=file, row=row, service=service)


def _changed(rows: DataFrame, file: str) -> DataFrame:
    sums = [F.sum(WRITTEN).alias(WRITTEN), F.count("*").alias("_rows")]
    return rows.groupBy(file).agg(*sums).where(F.col(WRITTEN) > 0)


def replace_by_name(
    spark: SparkSession, targets: DataFrame, sources: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Put source files (path, file_name) into the places of target files of the same name; the log, and the unmatched.

    Of several target files of one name the first by path is replaced, of several source files the last by
    path is taken.
    """
    place = targets.groupBy("file_name").agg(F.min("path").alias("path"))
    taken = sources.groupBy("file_name").agg(F.max("path").alias("source"))
    pairs = materialize(taken.join(place, "file_name", "left"), "file-pairs")
    log = exchange_files(pairs.where("path is not null"), "replaced-files")
    return log, pairs.where("path is null").select("file_name", F.col("source").alias("source_path"))
