"""Cell text, blank cells, row identities and text measures.

Everything here is a ``Column`` expression built from Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that a strip removes: all code points Unicode calls white space plus the
# four information separators.  None lies above U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _class_of(chars: str) -> str:
    """The inside of a pattern class: Latin-1 one by one, which patterns look up, the rest as ranges."""
    ranges: list[list[int]] = []
    for code in map(ord, chars):
        if code > 0xFF and ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


SPACE_CLASS = _class_of(WHITESPACE)

# A run of white space that is not one plain space already.
_LOOSE_SPACE = f"[{SPACE_CLASS}&&[^ ]][{SPACE_CLASS}]*| [{SPACE_CLASS}]+"

# Any other character; visible ASCII is tried first because it is a plain range.
_NON_SPACE = f"[!-~]|[^{SPACE_CLASS}]"

SEPARATOR = "|"


def column(name: str) -> Column:
    """The column of exactly this name, which may hold dots as headers do."""
    return F.col("`" + name.replace("`", "``") + "`")


# --- text of a cell -------------------------------------------------------------------


def _float_text(value: Column) -> Column:
    """Text of a floating point number: positional from 1e-4 up to 1e16, else with an exponent.

    The JVM may print more digits than it takes to tell a number apart, so a long text is
    tried with 15, 16 and 17 digits.
    """
    plain = value.cast("string")
    short, middle, full = (F.format_string(f"%.{n}e", value) for n in (14, 15, 16))
    shortest = (
        F.when(short.cast("double") == value, short)
        .when(middle.cast("double") == value, middle)
        .otherwise(full)
    )
    positional = F.regexp_replace(shortest.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0*$", "$1")
    scientific = F.regexp_replace(shortest, r"\.?0*[eE]\+?(?=\d)", "e+")
    scientific = F.regexp_replace(scientific, r"\.?0*[eE]-", "e-")
    scientific = F.regexp_replace(scientific, r"(?<sign>[+-])(\d)$", "${sign}0$2")
    is_positional = (F.abs(value) >= 1e-4) & (F.abs(value) < 1e16)
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(plain == "Infinity", F.lit("inf"))
        .when(plain == "-Infinity", F.lit("-inf"))
        .when(~plain.contains("E") & (F.length(plain) <= 16), plain)
        .when(is_positional, positional)
        .otherwise(scientific)
    )


def _timestamp_text(value: Column) -> Column:
    micros = F.date_format(value, "SSSSSS")
    seconds = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a cell; an empty cell stays NULL."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return value
    if isinstance(dtype, T.NullType):
        return value.cast("string")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(value.isNotNull(), _float_text(value))
    if isinstance(dtype, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if isinstance(dtype, T.DateType):
        return F.when(value.isNotNull(), _timestamp_text(value.cast("timestamp")))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.when(value.isNotNull(), _timestamp_text(value))
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return value.cast("string")
    raise TypeError(f"no cell text for a column of type {dtype.simpleString()}")


def text_or_empty(value: Column, dtype: T.DataType) -> Column:
    """Text of a cell; an empty cell becomes the empty text."""
    return F.coalesce(cell_text(value, dtype), F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """NULL, or white space only.  Stops at the first other character."""
    return text.isNull() | ~text.rlike(_NON_SPACE)


def same_value(old: Column, new: Column) -> Column:
    """No change: both blank, or equal text."""
    return (is_blank(old) & is_blank(new)) | old.eqNullSafe(new)


# --- identity -------------------------------------------------------------------------


def combined_identity(key: Column, match: Column) -> Column:
    """``key|match`` of two stripped parts, NULL unless both parts hold text."""
    return F.when((key != "") & (match != ""), F.concat(key, F.lit(SEPARATOR), match))


def key_identity(key: Column) -> Column:
    """The stripped key, NULL if it is empty."""
    return F.when(key != "", key)


# --- terms ----------------------------------------------------------------------------


def normalize_term(
    text: Column,
    *,
    trim: bool = True,
    collapse_whitespace: bool = True,
    punctuation: Mapping[str, str] | None = None,
) -> Column:
    if trim:
        text = strip(text)
    if collapse_whitespace:
        text = F.regexp_replace(text, _LOOSE_SPACE, " ")
    for old, new in (punctuation or {}).items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def dedup_key(term: Column, case_insensitive: bool) -> Column:
    return F.lower(term) if case_insensitive else term


def is_symbol_or_number_heavy(term: Column) -> Column:
    """Only ASCII digits, underscores and characters that are neither letter nor number."""
    return strip(term).rlike(r"\A[0-9_[^\p{L}\p{N}]]+\z")


def noise_ratio(term: Column) -> Column:
    """Share of the characters that are neither letter nor number; 0 for the empty text."""
    noise = F.length(F.regexp_replace(term, r"[\p{L}\p{N}]+", ""))
    return F.when(F.length(term) > 0, noise / F.length(term)).otherwise(F.lit(0.0))


def key_matches(key: Column, tokens: Sequence[str], *, regex: bool = False) -> Column:
    """Any token contained in the key, or any pattern found in it; case is ignored."""
    key = strip(key)
    hit = F.lit(False)
    for token in tokens:
        hit = hit | (key.rlike(f"(?iuUd){token}") if regex else F.lower(key).contains(token.lower()))
    return hit


# --- measures of untranslated text ----------------------------------------------------

CHINESE_CHARS = "chinese_chars"
ENGLISH_WORDS = "english_words"


def han_count(text: Column) -> Column:
    """Number of characters in U+4E00..U+9FA5."""
    return F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fa5}]+", ""))


def word_count(text: Column) -> Column:
    """Number of English words; apostrophes and hyphens join the parts of one word."""
    edge = r"[\p{L}\p{N}_]"
    return F.regexp_count(text, F.lit(rf"(?<!{edge})[a-zA-Z]+(?:['\-][a-zA-Z]+)*(?!{edge})"))


def count_units(text: Column, mode: str) -> Column:
    """Units of ``text`` in the given mode; an unknown mode counts nothing."""
    if mode == CHINESE_CHARS:
        units = han_count(text)
    elif mode == ENGLISH_WORDS:
        units = word_count(text)
    else:
        return F.lit(0).cast("bigint")
    return F.coalesce(units, F.lit(0)).cast("bigint")


def is_untranslated(text: Column) -> Column:
    """NULL, blank, or the text ``nan`` in any case."""
    return is_blank(text) | (F.lower(strip(text)) == "nan")
