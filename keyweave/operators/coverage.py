"""How much source text of each file has no translation yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import ENGLISH_WORDS, count_units, is_blank, is_untranslated
from keyweave.operators.rows import nullable_text_of

MEASURES = ("untranslated_chars", "untranslated_rows", "total_chars", "total_rows")

# The label of the totals row, and the headers of the report.
TOTAL_LABEL = "总计"
CHARACTER_HEADERS = ("文件名", "未翻译字数", "未翻译行数", "总字数", "总行数")
WORD_HEADERS = ("文件名", "未翻译词数", "未翻译行数", "总词数", "总行数")


def _measured(rows: DataFrame, file: str, source: str, translation: str, mode: str) -> DataFrame:
    text, other = nullable_text_of(rows, source), nullable_text_of(rows, translation)
    counted = rows.select(
        F.col(file).alias("file_name"),
        F.when(is_blank(text), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("total_rows"),
        count_units(text, mode).alias("total_chars"),
        is_untranslated(other).alias("_open"),
    )
    is_open = F.col("_open").cast("bigint")
    return counted.select(
        "file_name",
        (F.col("total_chars") * is_open).alias("untranslated_chars"),
        (F.col("total_rows") * is_open).alias("untranslated_rows"),
        "total_chars",
        "total_rows",
    )


def _sums() -> list:
    return [F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in MEASURES]


def untranslated_stats(
    rows: DataFrame,
    *,
    file: str,
    source: str,
    translation: str,
    mode: str = "chinese_chars",
    files: DataFrame | None = None,
) -> DataFrame:
    """Four sums per file.  ``files``, a table with the column ``file_name``, adds files without rows."""
    measured = _measured(rows, file, source, translation, mode)
    if files is not None:
        zeros = files.select("file_name", *(F.lit(0).cast("bigint").alias(m) for m in MEASURES))
        measured = measured.unionByName(zeros)
    return measured.groupBy("file_name").agg(*_sums())


def untranslated_stats_with_totals(
    rows: DataFrame, *, file: str, source: str, translation: str, mode: str = "chinese_chars"
) -> DataFrame:
    """The sums per file and, from the same scan, one row with the totals."""
    measured = _measured(rows, file, source, translation, mode)
    grouped = measured.rollup("file_name").agg(F.grouping("file_name").alias("_total"), *_sums())
    return grouped.select(
        F.when(F.col("_total") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("file_name")).alias("file_name"),
        *MEASURES,
    )


def untranslated_report(rows: DataFrame, *, mode: str = "chinese_chars", **columns) -> DataFrame:
    """The sums per file under the headers of the mode, the totals in the last row."""
    headers = WORD_HEADERS if mode == ENGLISH_WORDS else CHARACTER_HEADERS
    stats = untranslated_stats_with_totals(rows, mode=mode, **columns)
    return stats.orderBy(F.col("file_name") == TOTAL_LABEL, "file_name").toDF(*headers)


def report_of(stats: DataFrame, mode: str = "chinese_chars") -> DataFrame:
    """Sums per file as a report: the headers of the mode, files by name, the totals in the last row.

    ``stats`` has one row per file and is read twice; several files of one name are several rows.
    """
    headers = WORD_HEADERS if mode == ENGLISH_WORDS else CHARACTER_HEADERS
    total = stats.agg(*_sums()).select(F.lit(TOTAL_LABEL).alias("file_name"), *MEASURES, F.lit(True).alias("_last"))
    rows = stats.select("file_name", *MEASURES, F.lit(False).alias("_last")).unionByName(total)
    return rows.orderBy("_last", "file_name", *MEASURES).drop("_last").toDF(*headers)


def untranslated_summary(stats: DataFrame) -> DataFrame:
    """Number of files, untranslated units and untranslated rows."""
    return stats.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("untranslated_chars"), F.lit(0)).cast("bigint").alias("untranslated_chars"),
        F.coalesce(F.sum("untranslated_rows"), F.lit(0)).cast("bigint").alias("untranslated_rows"),
    )
