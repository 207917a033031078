"""Folders of tables: one file is one table.

A scan adds the path of the file, its name, and the row number in the file; all order rules
are computed from these columns, not from the order in which Spark reads.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.operators.candidates import header_map, missing_columns
from keyweave.operators.joins import inner_join_unique
from keyweave.operators.rows import nullable_text_of
from keyweave.session import materialize

FILE, NAME, ROW, ORDER = "_file", "_name", "_row", "_file_ord"
SERVICE = (FILE, NAME, ROW, ORDER)

# The first data row of a sheet is row 2, below the header.
FIRST_ROW = 2

# Error codes of unreadable files.
E_TARGET_READ = "E_TARGET_READ"
E_SOURCE_READ = "E_SOURCE_READ"
E_TERMINOLOGY_FILE = "E_TERMINOLOGY_FILE"
E_STATS_FILE = "E_STATS_FILE"
E_REPLACE_FILE = "E_REPLACE_FILE"
E_EDIT_COLUMN = "E_EDIT_COLUMN"


def list_files(
    spark: SparkSession,
    folder: str,
    extensions: Sequence[str] = (".parquet",),
    *,
    include_temp_files: bool = False,
    case_sensitive: bool = False,
) -> DataFrame:
    """``path``, ``file_name``, ``length`` and ``modified`` of the files below a folder; the contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )
    name = F.col("file_name") if case_sensitive else F.lower("file_name")
    wanted = F.lit(False)
    for extension in extensions:
        wanted = wanted | name.endswith(extension if case_sensitive else extension.lower())
    if not include_temp_files:
        wanted = wanted & ~F.col("file_name").startswith("~$")
    return files.filter(wanted)


def is_configured(file_name: Column, tokens: Sequence[str]) -> Column:
    """The file is named by a token; a token without extension names the stem.  No token: any file."""
    name = F.lower(file_name)
    stem = F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")
    hit = F.lit(not tokens)
    for token in (t.strip().lower() for t in tokens):
        if not token:
            continue
        hit = hit | (name == token)
        if not os.path.splitext(token)[1]:
            hit = hit | (stem == token)
    return hit


# --- which files can be read ----------------------------------------------------------

_PROBE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("layout", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
#: Kinds of files that tasks can read from a table of paths.
_BY_TASK = ("parquet", "orc")


def _opened(path: str):
    """The file system of a path as Spark lists it, not encoded, and the path within it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    # What follows the scheme may hold any character, so it is encoded for the URI.
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:/{quote(rest)}")


def _blocks(handle, kind: str, options: Mapping[str, str]):
    """The Arrow schema of an open file, and its rows in batches."""
    from pyarrow import csv, json, orc, parquet

    if kind == "parquet":
        table = parquet.ParquetFile(handle)
        return table.schema_arrow, table.iter_batches()
    if kind == "orc":
        table = orc.ORCFile(handle)
        return table.schema, (table.read_stripe(i) for i in range(table.nstripes))
    given = {name.lower(): value for name, value in options.items()}
    parse = csv.ParseOptions(
        delimiter=given.get("sep", given.get("delimiter", ",")), quote_char=given.get("quote", '"')
    )
    blocks = csv.open_csv(handle, parse_options=parse) if kind == "csv" else json.open_json(handle)
    return blocks.schema, blocks


def _file_columns(
    path: str, kind: str, whole: bool, options: Mapping[str, str]
) -> tuple[list[str], list[str], bytes]:
    """Column names, types and Arrow schema of one file; raises if it is no table of cells.

    ``whole`` reads the file to its end instead of its schema only.
    """
    system, inner = _opened(path)
    with system.open_input_file(inner) as handle:
        schema, blocks = _blocks(handle, kind, options)
        for field in schema:
            if pa.types.is_nested(field.type) or pa.types.is_binary(field.type):
                raise TypeError(f"column {field.name} of type {field.type} has no cell text")
        for _ in blocks if whole else ():
            pass
        # Spark reads every CSV column as text, so guessed types do not count.
        types = ["text" if kind == "csv" else str(field.type) for field in schema]
        return schema.names, types, schema.remove_metadata().serialize().to_pybytes()


def probe_files(
    files: DataFrame, kind: str = "parquet", *, whole: bool = False, options: Mapping[str, str] | None = None
) -> DataFrame:
    """Try every file in a Spark job: its columns and types, or the error that opening it gave.

    Without ``whole`` only the schema is read (the footer of a Parquet or ORC file); with it,
    every page is decoded, so that a file damaged in the middle is found as well.
    """

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name in zip(batch["path"], batch["file_name"]):
                try:
                    rows.append((path, name, *_file_columns(path, kind, whole, options or {}), None))
                except Exception as failure:  # noqa: BLE001 - any failure marks the file as bad
                    rows.append((path, name, None, None, None, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=_PROBE.names)

    return _dealt(files.select("path", "file_name")).mapInPandas(probe, _PROBE)


def _dealt(files: DataFrame) -> DataFrame:
    """A table of files over as many tasks as the session shuffles to; their rows are small, their work is not."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _read_by_task(files: DataFrame, kind: str, layout: bytes) -> DataFrame:
    """All rows of files of one schema, read in tasks from the table of their paths: path, row index and cells."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    cells = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(layout)))
    schema = T.StructType([T.StructField("_path", T.StringType()), T.StructField("_index", T.LongType()), *cells])
    target = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = _opened(path)
                done = 0
                with system.open_input_file(inner) as handle:
                    for block in _blocks(handle, kind, {})[1]:
                        n = block.num_rows
                        place = [pa.repeat(pa.scalar(path), n), pa.array(range(done, done + n), pa.int64())]
                        columns = [*place, *block.columns]
                        cast = [c.cast(field.type) for c, field in zip(columns, target, strict=True)]
                        yield pa.RecordBatch.from_arrays(cast, schema=target)
                        done += n

    return _dealt(files.select("path")).mapInArrow(read, schema)


@dataclass(frozen=True)
class FolderScan:
    """The readable files as one table per schema, the files, and the files that were left out."""

    tables: tuple[DataFrame, ...]
    files: DataFrame
    errors: DataFrame
    files_read: int
    files_failed: int

    @property
    def rows(self) -> DataFrame:
        """All rows in one table; a column that a file does not have is empty there."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.tables)


def scan_folder(
    spark: SparkSession,
    folder: str,
    *,
    kind: str = "parquet",
    extensions: Sequence[str] | None = None,
    include_temp_files: bool = False,
    tokens: Sequence[str] = (),
    required: Iterable[str] = (),
    exclude: Sequence[str] = (),
    row: str | None = None,
    error_code: str = E_SOURCE_READ,
    whole: bool = False,
    options: Mapping[str, str] | None = None,
    most_listed: int = 100_000,
    done: DataFrame | None = None,
) -> FolderScan:
    """Read the files of a folder; a file that cannot be read gives an error row, not a failure.

    All cells arrive as text, so files may differ in columns and types; files of one schema
    are one scan.  Parquet brings its own row numbers; tables of any other kind must hold
    theirs in the column ``row``.  ``required`` are header names every file must have, in
    any case; ``exclude`` are paths to leave out, such as the master itself.

    ``done`` are files (path, length, modified) to leave out as long as they are as they were then.

    The files are a table: what each holds, what is wrong with it.  Spark's readers want their paths on the driver.  Beyond
    ``most_listed`` files, Parquet and ORC files are read in tasks from the table instead, one task a file, and only what differs per
    schema comes to the driver.
    """
    if kind != "parquet" and row is None:
        raise ValueError(f"{kind} files carry no row numbers; name the column that does")
    listed = list_files(
        spark, folder, extensions or (f".{kind}",), include_temp_files=include_temp_files
    ).filter(is_configured(F.col("file_name"), tokens))
    if left_out := [_plain_path(p) for p in exclude]:
        listed = listed.where(~_without_scheme(F.col("path")).isin(left_out))
    if done is not None:
        listed = listed.join(done, ["path", "length", "modified"], "left_anti")
    probed = materialize(
        probe_files(listed, kind, whole=whole, options=options).withColumn("schema", F.xxhash64("columns", "types")),
        "probed-files",
    )
    needed = set(required) | ({row} if row else set())
    first = [F.min(c).alias(c) for c in ("columns", "layout")]
    schemas = probed.where("error is null").groupBy("schema").agg(*first).orderBy("schema").collect()
    lacks = {s.schema: ", ".join(missing_columns(header_map(s.columns), needed)) for s in schemas}
    message = F.col("error")
    for schema, missing in lacks.items():
        if missing:
            found = F.lit(f"columns not found: {missing}")
            message = F.when(F.col("schema") == schema, F.coalesce(message, found)).otherwise(message)
    judged = probed.withColumn("message", message)
    good, bad = judged.where("message is null"), judged.where("message is not null")
    failed = F.col("message").isNotNull()
    counts = judged.agg(F.count_if(~failed).alias("good"), F.count_if(failed).alias("bad")).first()
    if not counts["good"] and done is None:
        raise ValueError(f"{folder} has no file that can be read")

    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **(options or {}))
    by_task = counts["good"] > most_listed and kind in _BY_TASK

    def rows_of(schema: T.Row) -> DataFrame:
        files = good.where(F.col("schema") == schema["schema"])
        if by_task:
            table = _read_by_task(files, kind, schema["layout"])
            path, index = _same_form(F.col("_path")), F.col("_index")
        else:
            paths = [r["path"] for r in files.select("path").orderBy("path").collect()]
            table = reader.load([re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths])  # names, not patterns
            path, index = _decoded(F.col("_metadata.file_path")), F.col("_metadata.row_index")
        number = index + FIRST_ROW if kind == "parquet" else F.col(row)
        own = {"_path", "_index"} if by_task else set()
        cells = [c for c in table.columns if c not in own and (row is None or c.lower() != row.lower())]
        return table.select(
            path.alias(FILE),
            F.element_at(F.split(path, "/"), -1).alias(NAME),
            number.cast("bigint").alias(ROW),
            *(nullable_text_of(table, c).alias(c) for c in cells),
        )

    return FolderScan(
        tuple(rows_of(schema) for schema in schemas if not lacks[schema["schema"]]),
        good.select(_same_form(F.col("path")).alias("path"), "file_name"),
        bad.select(F.lit(error_code).alias("code"), "path", "file_name", "message").orderBy("path"),
        counts["good"],
        counts["bad"],
    )


def _same_form(path: Column) -> Column:
    """A listed path in the form in which scanned rows hold it."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def _decoded(uri: Column) -> Column:
    """The path a scan reports, without its URI encoding: the form of all tables of a scan."""
    return _same_form(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def _plain_path(path: str) -> str:
    """A path without scheme and double slashes, to compare a URI with a plain path."""
    return os.path.normpath("/" + path.split(":", 1)[-1].lstrip("/"))


# --- the order of the files -----------------------------------------------------------


def order_by_path(rows: DataFrame) -> DataFrame:
    """Files in the order of their lower-case paths."""
    return rows.withColumn(ORDER, F.struct(F.lower(FILE).alias("key"), F.col(FILE).alias("path")))


def order_by_name(rows: DataFrame) -> DataFrame:
    """Files in the order of their lower-case names, then of their paths."""
    return rows.withColumn(ORDER, F.struct(F.lower(NAME).alias("key"), F.col(FILE).alias("path")))


def _ranks(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    listed = dict.fromkeys(_plain_path(p.strip()) for p in paths if p and p.strip())
    if not listed:
        raise ValueError("the list of files is empty")
    return df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(listed)], f"_listed string, {ORDER} int")


def _without_scheme(path: Column) -> Column:
    """A scanned path is a URI; a listed one may be a plain path."""
    return F.concat(F.lit("/"), F.regexp_replace(path, "^[^:/]*:?/+", ""))


def order_by_priority(rows: DataFrame, paths: Sequence[str]) -> DataFrame:
    """The listed files only, in the order of the list; repeated paths count once."""
    ranks = _ranks(rows, paths)
    return inner_join_unique(rows.withColumn("_listed", _without_scheme(F.col(FILE))), ranks, ["_listed"]).drop("_listed")


def listed_first(files: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Of a list of files, those that ``order_by_priority`` keeps."""
    ranks = _ranks(files, paths).select("_listed")
    return files.withColumn("_listed", _without_scheme(F.col("path"))).join(ranks, "_listed").drop("_listed")


FOLDER_ORDER = [ORDER, ROW]
