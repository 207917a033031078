"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame.  All but the last
return rows of ``documents`` with the columns they came with, further ones included; the last one returns packed
pieces.  Every stage takes an empty table and gives an empty one, and takes NULL in any column: texts that are
NULL, empty or without a letter leave at the first stage, rows without doc_id stay.  Rows that repeat stay
together until the third stage, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyweave.llm import decontamination, langid, packing, quality, simhash
from keyweave.llm.columns import table
from keyweave.session import materialize, release


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the language model rejects go: texts without a letter, and those it is unsure of."""
    return langid.identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that break a rule of the threshold table go."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more) stays: by SimHash, then by the rest."""
    return simhash.one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers and names, go."""
    return decontamination.decontaminated(docs, table(spark, folder, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What is left is cut into pieces and packed into sequences of 2048 ids."""
    return packing.packed(docs)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]
#: Models, fingerprints and token ids are beyond SQL; the tests hold a brute-force pipeline against it.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs, before = table(spark, folder, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name.replace(" ", "-").lower())
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, folder)
