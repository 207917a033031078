"""Coverage statistics: documents by source, translated where a label gives a quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.catalog.base import Query, sql_blank, table
from keyweave.functions.text import CHINESE_CHARS, ENGLISH_WORDS
from keyweave.operators.coverage import (
    CHARACTER_HEADERS,
    MEASURES,
    TOTAL_LABEL,
    untranslated_report,
    untranslated_stats,
    untranslated_stats_with_totals,
    untranslated_summary,
)

COLUMNS = {"file": "source", "source": "text", "translation": "quality"}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return table(spark, folder, "documents").select("doc_id", "source", "text").join(labels, "doc_id", "left")


def han_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with a Han character appended up to six times."""
    times = (F.col("doc_id") % 7).cast("int")
    return documents(spark, folder).withColumn("text", F.concat("text", F.repeat(F.lit("字"), times)))


# A word is cut out of the text before it is counted if it touches a digit, an underscore or a
# letter outside ASCII; all other characters outside ASCII separate words.
WORDS_SQL = r"""len(regexp_extract_all(regexp_replace(regexp_replace(text,
      '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'),
      '[A-Za-z0-9_\x{80}-\x{10FFFF}]*[0-9_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*', ' ', 'g'),
      '[a-zA-Z]+(?:[''\-][a-zA-Z]+)*'))"""
_HAN_TEXT = "text || repeat('字', doc_id % 7)"
_REPORT = ", ".join(f'{m} AS "{h}"' for m, h in zip(("file_name", *MEASURES), CHARACTER_HEADERS))
_HAN = "length(regexp_replace(text, '[^一-龥]', '', 'g'))"


def _stats_sql(units: str, text: str = "text") -> str:
    return f"""
WITH docs AS (
  SELECT source AS file_name, {text} AS text, CAST(quality AS VARCHAR) AS translation
  FROM documents LEFT JOIN labels USING (doc_id)
), measured AS (
  SELECT file_name, CAST(NOT {sql_blank("text")} AS BIGINT) AS n, {units} AS units,
         CAST({sql_blank("translation")} OR lower(translation) = 'nan' AS BIGINT) AS is_open
  FROM docs
), stats AS (
  SELECT file_name, CAST(sum(units * is_open) AS BIGINT) AS untranslated_chars,
         CAST(sum(n * is_open) AS BIGINT) AS untranslated_rows,
         CAST(sum(units) AS BIGINT) AS total_chars, CAST(sum(n) AS BIGINT) AS total_rows
  FROM measured GROUP BY file_name
)"""


def _by_path(spark: SparkSession, folder: str) -> DataFrame:
    """Two folders of files with the same names: statistics are kept per path."""
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "x/").otherwise("y/"), "source")
    rows = documents(spark, folder).withColumn("path", path)
    stats = untranslated_stats(rows, **{**COLUMNS, "file": "path"}, mode=ENGLISH_WORDS)
    return stats.select(
        F.col("file_name").alias("path"), F.element_at(F.split("file_name", "/"), -1).alias("file_name"), *MEASURES
    )


_BY_PATH_SQL = f"""
WITH stats AS ({_stats_sql(WORDS_SQL).replace("SELECT source AS file_name", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'x/' ELSE 'y/' END || source AS file_name")}
SELECT * FROM stats)
SELECT file_name AS path, split_part(file_name, '/', 2) AS file_name, {", ".join(MEASURES)} FROM stats"""


QUERIES = {
    "untranslated_by_path": Query(_by_path, _BY_PATH_SQL),
    "untranslated_words_by_file": Query(
        lambda s, d: untranslated_stats(documents(s, d), **COLUMNS, mode=ENGLISH_WORDS),
        f"{_stats_sql(WORDS_SQL)} SELECT * FROM stats",
    ),
    "untranslated_han_by_file": Query(
        lambda s, d: untranslated_stats(han_documents(s, d), **COLUMNS, mode=CHINESE_CHARS),
        f"{_stats_sql(_HAN, _HAN_TEXT)} SELECT * FROM stats",
    ),
    "untranslated_with_totals": Query(
        lambda s, d: untranslated_stats_with_totals(documents(s, d), **COLUMNS, mode=ENGLISH_WORDS),
        f"""{_stats_sql(WORDS_SQL)} SELECT * FROM stats UNION ALL
SELECT '{TOTAL_LABEL}', CAST(sum(untranslated_chars) AS BIGINT), CAST(sum(untranslated_rows) AS BIGINT),
       CAST(sum(total_chars) AS BIGINT), CAST(sum(total_rows) AS BIGINT) FROM stats""",
    ),
    "untranslated_report": Query(
        lambda s, d: untranslated_report(han_documents(s, d), **COLUMNS, mode=CHINESE_CHARS),
        f"""{_stats_sql(_HAN, _HAN_TEXT)}, report AS (
  SELECT * FROM stats UNION ALL
  SELECT '{TOTAL_LABEL}', CAST(sum(untranslated_chars) AS BIGINT), CAST(sum(untranslated_rows) AS BIGINT),
         CAST(sum(total_chars) AS BIGINT), CAST(sum(total_rows) AS BIGINT) FROM stats
)
SELECT {_REPORT} FROM report""",
    ),
    "untranslated_summary": Query(
        lambda s, d: untranslated_summary(untranslated_stats(documents(s, d), **COLUMNS, mode=ENGLISH_WORDS)),
        f"""{_stats_sql(WORDS_SQL)} SELECT count(*) AS files,
       CAST(sum(untranslated_chars) AS BIGINT) AS untranslated_chars,
       CAST(sum(untranslated_rows) AS BIGINT) AS untranslated_rows FROM stats""",
    ),
}
