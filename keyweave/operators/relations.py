"""Relations between terms: one term in several files, and bodies that share affixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import dedup_key
from keyweave.operators.affixes import with_halves
from keyweave.operators.joins import inner_join_unique
from keyweave.operators.lists import COUNT, LIST, PART, list_cells
from keyweave.operators.terms import BODY, SUFFIX, TERM, normal_form
from keyweave.plans.term_config import TermConfig
from keyweave.session import materialize

# Headers of the relations report: fixed values.
RELATION_COLUMNS = [
    "relation_type",
    "evidence_count",
    "cross_term",
    "cross_files_count",
    "cross_files_list",
    "affix_role",
    "affix_anchor_term",
    "affix_related_count",
    "affix_related_list",
    "affix_delimiters",
    "notes",
]
_COUNTS = {"evidence_count", "cross_files_count", "affix_related_count"}


def _relation(df: DataFrame, **columns) -> DataFrame:
    """Rows in the relation layout and their ``items_part``; what is not given is empty, or 0 for a count."""
    zero, empty = F.lit(0).cast("bigint"), F.lit("")
    given = (columns.get(c, zero if c in _COUNTS else empty).alias(c) for c in RELATION_COLUMNS)
    return df.select(*given, PART)


def cross_file_terms(known: DataFrame, files: DataFrame) -> DataFrame:
    """Terms that occur in two files or more, a row for each piece of their file list."""
    lists = files.filter(F.col(COUNT) >= 2)
    return _relation(
        known.select(*TERM, "term_norm", "occurrences_count").join(lists, TERM),
        relation_type=F.lit("cross_file"),
        evidence_count=F.col("occurrences_count"),
        cross_term=F.col("term_norm"),
        cross_files_count=F.col(COUNT),
        cross_files_list=F.col(LIST),
    )


def affix_pairs(found: DataFrame, known: DataFrame, config: TermConfig) -> DataFrame:
    """Pairs of a known body and a known suffix over all candidates, stored.

    Pairs are counted before they meet the terms, so a frequent pair is one row.  There is
    one flag per delimiter, which says whether the pair was written with it.
    """
    settings = config.normalization
    halves = with_halves(found.select("term_raw"), "term_raw", config.affix_delimiters)
    forms = (
        halves.filter(F.col("delimiter").isNotNull())
        .select(
            normal_form(F.col("body"), settings).alias("body"),
            normal_form(F.col("suffix"), settings).alias("suffix"),
            "delimiter",
        )
        .filter((F.col("body") != "") & (F.col("suffix") != ""))
    )
    keys = [dedup_key(F.col(c), settings.case_insensitive_dedup).alias(f"{c}_key") for c in (BODY, SUFFIX)]
    pairs = (
        forms.select(*keys, "delimiter")
        .groupBy("body_key", "suffix_key")
        .agg(
            F.count(F.lit(1)).alias("evidence"),
            *(
                F.max((F.col("delimiter") == d).cast("int")).alias(f"_delimiter_{i}")
                for i, d in enumerate(config.affix_delimiters)
            ),
        )
    )
    for kind in (BODY, SUFFIX):
        texts = known.filter(F.col("term_type") == kind).select(
            F.col("dedup_key").alias(f"{kind}_key"), F.col("term_norm").alias(f"{kind}_term")
        )
        pairs = inner_join_unique(pairs, texts, [f"{kind}_key"])
    return materialize(pairs, "affix-pairs")


def related_terms(pairs: DataFrame) -> DataFrame:
    """Each anchor with each related term, once: (role, anchor_key, anchor_term, related_term)."""

    def seen_from(anchor: str, other: str, role: str) -> DataFrame:
        return pairs.select(
            F.lit(role).alias("role"),
            F.col(f"{anchor}_key").alias("anchor_key"),
            F.col(f"{anchor}_term").alias("anchor_term"),
            F.col(f"{other}_term").alias("related_term"),
        )

    return seen_from(BODY, SUFFIX, "prefix_anchor").union(seen_from(SUFFIX, BODY, "suffix_anchor"))


def affix_groups(pairs: DataFrame, delimiters: Sequence[str], **options) -> DataFrame:
    """Suffixes per body, and bodies per suffix, a row for each piece of their list."""
    by = ["role", "anchor_key", "anchor_term"]
    lists = list_cells(related_terms(pairs), by, "related_term", **options)
    flags = [f"_delimiter_{i}" for i in range(len(delimiters))]

    def totals(anchor: str, role: str) -> DataFrame:
        return pairs.groupBy(F.lit(role).alias("role"), F.col(f"{anchor}_key").alias("anchor_key")).agg(
            F.sum("evidence").alias("evidence"), *(F.max(f).alias(f) for f in flags)
        )

    sums = totals(BODY, "prefix_anchor").union(totals(SUFFIX, "suffix_anchor"))
    used = F.array_compact(F.array(*(F.when(F.col(f) == 1, d) for f, d in zip(flags, delimiters))))
    return _relation(
        lists.join(sums, ["role", "anchor_key"]),
        relation_type=F.lit("affix_group"),
        evidence_count=F.col("evidence"),
        affix_role=F.col("role"),
        affix_anchor_term=F.col("anchor_term"),
        affix_related_count=F.col(COUNT),
        affix_related_list=F.col(LIST),
        affix_delimiters=F.array_join(F.array_sort(F.array_distinct(used)), ";"),
    )


def relation_keys(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per relation, without its lists: terms in several files, bodies, suffixes."""
    cross = known.filter(F.col("files_count") >= 2).select("dedup_key")
    anchors = [pairs.select(f"{kind}_key").distinct() for kind in (BODY, SUFFIX)]
    return cross.union(anchors[0]).union(anchors[1])


def relations_summary(cross: DataFrame, groups: DataFrame) -> DataFrame:
    return cross.unionByName(groups).orderBy(
        "relation_type", "affix_role", "affix_anchor_term", PART, "affix_related_list", "cross_term"
    )
