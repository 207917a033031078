"""Terms: candidates split into components and grouped by type and normal form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import dedup_key, is_symbol_or_number_heavy, noise_ratio, normalize_term
from keyweave.functions.winners import position
from keyweave.operators.affixes import with_halves
from keyweave.operators.candidates import CANDIDATE_ORDER
from keyweave.operators.joins import inner_join_unique
from keyweave.operators.lists import COUNT, LIST, PART, list_cells
from keyweave.operators.sequence import numbered
from keyweave.plans.term_config import Normalization, TermConfig, Thresholds

BODY, SUFFIX = "body", "suffix"
TERM = ["term_type", "dedup_key"]


def normal_form(text: Column, settings: Normalization) -> Column:
    return normalize_term(
        text,
        trim=settings.trim,
        collapse_whitespace=settings.collapse_whitespace,
        punctuation=settings.punctuation,
    )


def normalized_candidates(found: DataFrame, settings: Normalization) -> DataFrame:
    """Candidates whose normal form is long enough."""
    return found.filter(F.length(normal_form(F.col("term_raw"), settings)) >= settings.min_term_length)


def components(found: DataFrame, config: TermConfig) -> DataFrame:
    """One row per component: the whole term as body, or its body and its suffix."""
    settings = config.normalization

    def component(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("term_type"), text.alias("display_term"))

    split = F.array(component(BODY, F.col("body")), component(SUFFIX, F.col("suffix")))
    whole = F.array(component(BODY, F.col("term_raw")))
    parts = with_halves(normalized_candidates(found, settings), "term_raw", config.affix_delimiters)
    exploded = parts.select(
        *found.columns, F.inline(F.when(F.col("delimiter").isNotNull(), split).otherwise(whole))
    )
    return (
        exploded.withColumn("_form", normal_form(F.col("display_term"), settings))
        .filter(F.length("_form") >= settings.min_term_length)
        .withColumn("dedup_key", dedup_key(F.col("_form"), settings.case_insensitive_dedup))
        .drop("_form")
    )


def review_reasons(term: Column, thresholds: Thresholds) -> Column:
    """Array of the reasons to look at a term again."""
    return F.array_compact(
        F.array(
            F.when(F.length(term) <= thresholds.review_short_len_le, "too_short"),
            F.when(is_symbol_or_number_heavy(term), "symbol_or_number_heavy"),
            F.when(
                (F.length(term) > 0) & (noise_ratio(term) >= thresholds.review_noise_ratio_ge),
                "high_noise_ratio",
            ),
        )
    )


def term_state(parts: DataFrame, order: Sequence[str] = CANDIDATE_ORDER) -> DataFrame:
    """One row per term and file: how often the term occurs there, and its first occurrence with its place.

    The state of more files is the union of theirs, so files can be mined when they arrive (``merged_state``).
    """
    first = F.struct("display_term", "extractor_type", "file", "row", "col")
    return parts.groupBy(*TERM, "file").agg(
        F.count(F.lit(1)).alias("occurrences_count"),
        F.min_by(first, position(order)).alias("first"),
        F.min(position(order)).alias("place"),
    )


def merged_state(states: Sequence[DataFrame]) -> DataFrame:
    """The state of all files of several states; a name that several of them have is one file."""
    return (
        reduce(DataFrame.unionByName, states)
        .groupBy(*TERM, "file")
        .agg(
            F.sum("occurrences_count").alias("occurrences_count"),
            F.min_by("first", "place").alias("first"),
            F.min("place").alias("place"),
        )
    )


def merged_keys(keys: Sequence[DataFrame]) -> DataFrame:
    """Each term with each of its keys, once, over several tables of ``term_keys``."""
    return reduce(DataFrame.unionByName, keys).distinct()


def terms(state: DataFrame, thresholds: Thresholds) -> DataFrame:
    """The distinct terms of a state, stored and numbered ``T000001`` ... by type and normal form.

    The first occurrence gives the text shown, the extractor and the sample place.
    """
    grouped = state.groupBy(*TERM).agg(
        F.sum("occurrences_count").alias("occurrences_count"),
        F.count(F.lit(1)).alias("files_count"),
        F.min_by("first", "place").alias("_first"),
    )
    rows = grouped.select(
        *TERM,
        F.col("_first.display_term").alias("term_norm"),
        "occurrences_count",
        "files_count",
        F.col("_first.extractor_type").alias("first_extractor"),
        F.col("_first.file").alias("sample_file"),
        F.col("_first.row").alias("sample_row"),
        F.col("_first.col").alias("sample_col"),
    ).withColumn("_reasons", review_reasons(F.col("term_norm"), thresholds))
    return numbered(rows, TERM, "_term_nr", label="terms").select(
        F.format_string("T%06d", "_term_nr").alias("term_id"),
        *rows.drop("_reasons").columns,
        (F.size("_reasons") > 0).alias("is_low_confidence"),
        F.array_join("_reasons", ";").alias("review_reasons"),
    )


# Headers of the terms report: fixed values.
TERM_COLUMNS = [
    "term_id",
    "term_type",
    "term_norm",
    "dedup_key",
    "occurrences_count",
    "files_count",
    "first_extractor",
    "is_low_confidence",
    "review_reasons",
]


def term_files(state: DataFrame) -> DataFrame:
    """Each term with each of its files, once."""
    return state.select(*TERM, "file")


def term_keys(parts: DataFrame) -> DataFrame:
    """Each term with each of its keys, once; blank keys do not count."""
    return parts.filter(F.col("key_value") != "").select(*TERM, "key_value").distinct()


def terms_summary(known: DataFrame, files: DataFrame, keys: DataFrame) -> DataFrame:
    """Terms with the lists of their files and keys, in (type, text, id, part) order.

    A term has a row for each piece of its longer list; ``items_part`` numbers the pieces.
    """
    here = files.select(*TERM, PART, F.col(LIST).alias("files_list"))
    there = keys.select(*TERM, PART, F.col(LIST).alias("keys_list"))
    counts = keys.filter(F.col(PART) == 0).select(*TERM, F.col(COUNT).alias("keys_count"))
    pieces = here.join(there, [*TERM, PART], "full")
    joined = known.join(pieces, TERM).join(counts, TERM, "left")
    return joined.select(
        "term_id",
        "term_type",
        "term_norm",
        "occurrences_count",
        "files_count",
        F.coalesce("files_list", F.lit("")).alias("files_list"),
        F.coalesce("keys_count", F.lit(0).cast("bigint")).alias("keys_count"),
        F.coalesce("keys_list", F.lit("")).alias("keys_list"),
        "first_extractor",
        "is_low_confidence",
        "review_reasons",
        PART,
    ).orderBy("term_type", "term_norm", "term_id", PART)


def review_items(known: DataFrame) -> DataFrame:
    """One row per term and reason, with the first occurrence as sample."""
    return (
        known.filter(F.col("is_low_confidence"))
        .select(
            "term_id",
            "term_norm",
            F.posexplode(F.split("review_reasons", ";")).alias("_nr", "reason"),
            F.lit("medium").alias("severity"),
            "occurrences_count",
            "sample_file",
            "sample_row",
            "sample_col",
        )
        .orderBy("term_id", "_nr")
        .drop("_nr")
    )


# Headers of the details report: fixed values.
DETAIL_COLUMNS = [
    "term_id",
    "term_type",
    "term_norm",
    "candidate_id",
    "extractor_type",
    "rule_id",
    "file",
    "sheet",
    "row",
    "col",
    "key_value",
    "version_value",
    "term_raw",
    "cell_raw",
]


def term_occurrences(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Every component with its term; ``term_id`` and ``candidate_id`` give the order."""
    return inner_join_unique(parts, known.select(*TERM, "term_id", "term_norm"), TERM)
