"""Scalar functions and winners on their own, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.catalog import sync_queries as S
from keyweave.catalog.coverage_queries import WORDS_SQL
from keyweave.catalog.base import Query, sql_blank, sql_changed, sql_identity, sql_key_identity, sql_strip, table
from keyweave.functions import text as X
from keyweave.operators.affixes import with_halves
from keyweave.operators.rows import ID, KEY_ONLY, nullable_text_of, with_identity
from keyweave.operators.sync import master_index, target_winners

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_TYPED = ["l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
DELIMITERS = (", ", ". ")


def _cell_texts(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(*_LINE, *(nullable_text_of(lines, c).alias(f"{c}_text") for c in _TYPED))


def _identities(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.forward_targets(spark, folder).select("file", *_LINE, "key", "match")
    combined = with_identity(rows, "key", "match").withColumnRenamed(ID, "combined")
    return with_identity(combined, "key", None, KEY_ONLY).withColumnRenamed(ID, "key_only").drop("key", "match")


_IDENTITY_SQL = f"""{S.FORWARD_SQL}
SELECT file, {', '.join(_LINE)}, id AS combined, {sql_key_identity("key")} AS key_only FROM target"""


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """The status, NULL for one of them, against another text that is blank for some rows."""
    orders = table(spark, folder, "orders")
    old = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    new = F.when(F.col("o_orderpriority") < "3", F.lit("O")).otherwise(F.lit("  "))
    return orders.select("o_orderkey", X.same_value(old, new).alias("unchanged"))


_OLD = "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END"
_NEW = "CASE WHEN o_orderpriority < '3' THEN 'O' ELSE '  ' END"


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    form = X.normalize_term(text, punctuation={"—": "-", ".": ""})
    return table(spark, folder, "documents").select(
        "doc_id",
        F.length(form).cast("bigint").alias("form_length"),
        F.md5(X.dedup_key(form, True)).alias("form_hash"),
        X.han_count(text).cast("bigint").alias("han"),
        X.word_count(text).cast("bigint").alias("words"),
        X.is_symbol_or_number_heavy(text).alias("heavy"),
        F.round(X.noise_ratio(text), 9).alias("noise"),
        X.is_untranslated(text).alias("untranslated"),
    )


_FORM = f"""replace(replace(regexp_replace({sql_strip("text")}, '[{X.SPACE_CLASS}]+', ' ', 'g'), '—', '-'), '.', '')"""


_MEASURES_SQL = f"""
SELECT doc_id, length({_FORM}) AS form_length, md5(lower({_FORM})) AS form_hash,
       length(regexp_replace(text, '[^一-龥]', '', 'g')) AS han, CAST({WORDS_SQL} AS BIGINT) AS words,
       regexp_full_match({sql_strip("text")}, '([0-9_]|[^\\p{{L}}\\p{{N}}])+') AS heavy,
       round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\\p{{L}}\\p{{N}}]+', '', 'g')) / length(text)
                  ELSE 0 END, 9) AS noise,
       {sql_blank("text")} OR lower({sql_strip("text")}) = 'nan' AS untranslated
FROM documents"""


def _halves(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return with_halves(turns, "text", DELIMITERS).select(
        "conv_id", "turn", "body", F.md5("suffix").alias("suffix_hash"), "delimiter"
    )


_HALVES_SQL = f"""
WITH placed AS (
  SELECT *, least(nullif(instr(text, '{DELIMITERS[0]}'), 0), nullif(instr(text, '{DELIMITERS[1]}'), 0)) AS pos
  FROM conversations
), cut AS (
  SELECT *, {sql_strip("substr(text, 1, pos - 1)")} AS body0, substr(text, pos, 2) AS delimiter0,
         substr(text, pos + 2) AS payload
  FROM placed
), split AS (
  SELECT *, pos IS NOT NULL AND body0 <> '' AND NOT {sql_blank("payload")} AS ok FROM cut
)
SELECT conv_id, turn, CASE WHEN ok THEN body0 END AS body,
       CASE WHEN ok THEN md5(delimiter0 || payload) END AS suffix_hash,
       CASE WHEN ok THEN delimiter0 END AS delimiter
FROM split"""


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return master_index(S.forward_master(spark, folder), S.MASTER_TWO, ["p_partkey"]).toDF(
        "identity", "name", "size"
    )


def _winners(spark: SparkSession, folder: str) -> DataFrame:
    return target_winners(S.reverse_targets(spark, folder), S.REVERSE_TARGET, S.REVERSE_ORDER).toDF(
        "identity", "content"
    )


QUERIES = {
    "cell_texts": Query(
        _cell_texts,
        f"""SELECT {', '.join(_LINE)}, {', '.join(f"CAST({c} AS VARCHAR) AS {c}_text" for c in _TYPED)}
FROM lineitem""",
    ),
    "row_identities": Query(_identities, _IDENTITY_SQL),
    "unchanged_cells": Query(
        _changes, f"SELECT o_orderkey, NOT {sql_changed(_OLD, _NEW)} AS unchanged FROM orders"
    ),
    "text_measures": Query(_measures, _MEASURES_SQL),
    "affix_halves": Query(_halves, _HALVES_SQL),
    "master_index": Query(_index, f"{S.FORWARD_SQL} SELECT id AS identity, name, size FROM idx"),
    "target_winners": Query(
        _winners,
        f"""WITH target AS (
  SELECT {sql_identity("CAST(l_orderkey AS VARCHAR)", "l_linestatus")} AS identity,
     CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS content,
     row(l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place
  FROM lineitem
)
SELECT identity, arg_max(content, place) AS content FROM target
WHERE identity IS NOT NULL AND NOT {sql_blank("content")} GROUP BY identity""",
    ),
}
