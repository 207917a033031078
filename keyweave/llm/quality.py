"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over one row, so a document is judged where it is
read: no shuffle, no Python.  The rules are data (``Rule``); ``verdict`` compiles any
table of them into one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import let, space_words

#: Frequent short words of English, German, French and Spanish prose.
STOP_WORDS = (
    "the of and to in a is that for it as with on by at this be are or from an was not "
    "der die das und in den von zu mit ist des dem nicht ein eine als auch auf für im sich es an "
    "le la les de des du et en un une que qui est dans pour par sur au ne pas plus avec "
    "el los las y del se por con una su para no lo más como"
).split()
#: Languages whose stop words are held; a text without a language is judged by them too.
STOP_LANGUAGES = ("en", "de", "fr", "es")

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document passes while ``least <= measure <= most``; an open end is None.

    A rule with ``languages`` only judges texts in one of them, and texts without a language.
    """

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    languages: tuple[str, ...] = ()


#: The contract's own two rules.
BASE_RULES = (
    Rule("too_few_words", "n_words", least=50),
    Rule("repeated_words", "repeat_percent", most=50),
)
#: The method's rules.  They are wide: prose lies well inside, whatever its length, its case and its language.
RULES = (
    Rule("word_length", "mean_word_chars", least=2, most=20),
    Rule("symbols", "symbols_per_word", most=0.5),
    Rule("stop_words", "stop_word_share", least=0.05, languages=STOP_LANGUAGES),
    Rule("repeated_lines", "dup_line_share", most=0.5),
)


def _repeat_words(windows: Column) -> Column:
    """Words covered by a window hash that occurs twice or more.

    The windows are sorted by hash, those equal to a neighbour are kept, and the words that
    the kept places cover are added up: three each, less what the next place covers again.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(pairs: Column) -> Column:
        def equals_neighbour(pair: Column, at: Column) -> Column:
            before, after = F.get(pairs, at - 1)["h"], F.get(pairs, at + 1)["h"]
            return F.coalesce(before == pair["h"], F.lit(False)) | F.coalesce(
                after == pair["h"], F.lit(False)
            )

        return F.sort_array(F.transform(F.filter(pairs, equals_neighbour), lambda pair: pair["i"]))

    def covered(places: Column) -> Column:
        gaps = F.transform(
            places,
            lambda place, at: F.least(F.lit(3), F.coalesce(F.get(places, at + 1) - place, F.lit(3))),
        )
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    return let(let(placed, again), covered)


def _counts(text: Column) -> Column:
    """All counts of one text, as a struct; stop words count in any case.

    Words, lines and windows are bound with ``let``: each is computed once per row, wherever the
    optimizer moves the expression.
    """
    clean = F.coalesce(text, F.lit(""))

    def stop_word(word: Column) -> Column:
        return F.lower(word).isin(sorted(set(STOP_WORDS)))

    def window_hashes(words: Column) -> Column:
        return F.when(
            F.size(words) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def counted(words: Column, lines: Column) -> Column:
        repeated = let(
            window_hashes(words),
            lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
                _repeat_words(hashes)
            ),
        )
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(clean, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeated.cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(words, lambda word: stop_word(word))).cast("bigint").alias("n_stop_words"),
        )

    lines = F.filter(F.split(clean, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(space_words(text), lambda words: let(lines, lambda held: counted(words, held)))


def _measures(counts: Column) -> dict[str, Column]:
    def ratio(part: str, whole: str) -> Column:
        return F.when(counts[whole] > 0, counts[part] / counts[whole]).otherwise(F.lit(0.0))

    plain = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    return {name: counts[name] for name in plain} | {
        "repeat_percent": 100 * ratio("n_repeat_words", "n_words"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_share": ratio("n_stop_words", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
    }


def language_code(lang: Column) -> Column:
    """The first letters of a language value: ``en`` of ``EN`` and ``en-GB``; NULL for NULL."""
    return F.regexp_replace(F.lower(F.substring(lang.cast("string"), 1, 3)), "[^a-z].*$", "")


def verdict(
    text: Column,
    base: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = RULES,
    lang: Column | None = None,
) -> Column:
    """The threshold tables compiled into one expression over a text and its language.

    It is a struct of all measures, ``base_failed``, ``broken`` (the names of the broken rules, in the
    order of the tables) and ``kept`` (none is broken).  NULL, empty and blank texts have no
    words, and every measure 0.  Words are ``[^\\x20\\x09-\\x0D]+``; a line counts as a repeated one if
    it has a word and equals an earlier line.  Repeated three-word windows are found by a
    64-bit hash within the text.
    """

    def judged(counts: Column) -> Column:
        measures = _measures(counts)

        def broken(rule: Rule) -> Column:
            value, found = measures[rule.measure], F.lit(False)
            if rule.least is not None:
                found = found | (value < rule.least)
            if rule.most is not None:
                found = found | (value > rule.most)
            if rule.languages and lang is not None:
                found = found & F.coalesce(language_code(lang).isin(*rule.languages), F.lit(True))
            return found

        def any_of(table: Sequence[Rule]) -> Column:
            return reduce(Column.__or__, map(broken, table), F.lit(False))

        names = [F.when(broken(rule), F.lit(rule.name)) for rule in (*base, *rules)]
        return F.struct(
            *(value.alias(name) for name, value in measures.items()),
            any_of(base).alias("base_failed"),
            F.array_compact(F.array(F.lit(None).cast("string"), *names)).alias("broken"),
            (~any_of((*base, *rules))).alias("kept"),
        )

    return let(_counts(text), judged)


def _language(docs: DataFrame) -> Column | None:
    return F.col("lang") if "lang" in docs.columns else None


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with the columns they came with.

    NULL, empty and blank texts have no words and go.  Repeated rows get one verdict and stay or go together; an empty
    table stays empty.  A table without ``lang`` is judged as texts without a language.
    """
    return docs.where(verdict(F.col(text), lang=_language(docs))["kept"])


def quality_of_documents(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document: the rows of the query.

    Each row is judged by itself, so repeated rows get equal verdicts and an empty table gives
    an empty one.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = verdict(F.col("text"), lang=_language(docs)).alias("verdict")
    done = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), found)
    return done.select("doc_id", *(f"verdict.{name}" for name in names))
