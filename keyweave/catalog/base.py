"""Shared pieces of the query catalogue: table access and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from keyweave.functions.text import WHITESPACE


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SPACES = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def sql_strip(text: str) -> str:
    return f"trim({text}, {_SPACES})"


def sql_blank(text: str) -> str:
    return f"({text} IS NULL OR {sql_strip(text)} = '')"


def sql_identity(key: str, match: str) -> str:
    key, match = sql_strip(f"coalesce({key}, '')"), sql_strip(f"coalesce({match}, '')")
    return f"CASE WHEN {key} <> '' AND {match} <> '' THEN {key} || '|' || {match} END"


def sql_key_identity(key: str) -> str:
    return f"nullif({sql_strip(f'''coalesce({key}, '')''')}, '')"


def sql_changed(old: str, new: str) -> str:
    """A new text (never NULL where it matters) that is a change of the old one."""
    return (
        f"({new} IS NOT NULL AND NOT ({sql_blank(old)} AND {sql_blank(new)}) "
        f"AND {old} IS DISTINCT FROM {new})"
    )
