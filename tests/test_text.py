"""Cell text, blanks, identities, and text measures against plain Python."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions import text as X
from keyweave.operators.affixes import HALVES, with_halves
from keyweave.operators.rows import ID, KEY_ONLY, with_identity

ODD = ["", " ", "a", " x　", "\x1c\x1fk\x85", "​z​", "tab\tin", " a  b ", "﻿", "᠎", "é ñ", "nan", "NaN ", "0", "𝒳 𝒴", " l "]


def column(spark, values, dtype="string"):
    schema = T.StructType([T.StructField("nr", T.IntegerType()), T.StructField("v", T._parse_datatype_string(dtype))])
    return spark.createDataFrame(list(enumerate(values)), schema)


def results(df, expression):
    return [r[0] for r in df.orderBy("nr").select(expression).collect()]


def test_white_space_is_what_python_strips():
    assert len(X.WHITESPACE) == 29
    assert X.WHITESPACE.strip() == ""


def test_strip_and_blank(spark):
    values = ODD + [c + "m" + c for c in X.WHITESPACE] + [None]
    df = column(spark, values)
    assert results(df, X.strip(F.col("v"))) == [None if v is None else v.strip() for v in values]
    assert results(df, X.is_blank(F.col("v"))) == [v is None or v.strip() == "" for v in values]


def test_same_value(spark):
    pairs = [(None, ""), (" ", None), ("", "  "), ("a", "a"), ("a", "a "), (None, "a"), ("a", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "nr int, a string, b string")
    assert results(df, X.same_value(F.col("a"), F.col("b"))) == [True, True, True, True, False, False, False]


def test_identity_is_a_concatenation(spark):
    pairs = [("K", "M"), (" K ", " M"), ("a|b", "c"), ("a", "b|c"), ("", "M"), ("K", "  "), (None, "M")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "nr int, k string, m string")
    assert results(with_identity(df, "k", "m"), ID) == ["K|M", "K|M", "a|b|c", "a|b|c", None, None, None]
    assert results(with_identity(df, "k", None, KEY_ONLY), ID) == ["K", "K", "a|b", "a", None, "K", None]


FLOATS = [0.0, -0.0, 1.0, 12.34, 0.25, 1 / 3, -2.5, 1e7, 12345678.0, 123456789.125, 1e10, -1e15, 9007199254740993.0,
          1e16, 1.5e16, 1e22, -3.25e100, 0.001, 0.00012, 0.0001, 0.00001, 1.25e-7, 5e-300, float("inf"), float("-inf"), float("nan")]


def test_float_text_is_positional_where_python_is(spark):
    rng = random.Random(5)
    values = FLOATS + [round(rng.uniform(-1e6, 1e6), 3) for _ in range(300)] + [None]
    values += [float(f"{rng.randint(1, 9999)}e{rng.randint(-12, 18)}") for _ in range(300)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(300)]
    df = column(spark, values, "double")
    dtype = T.DoubleType()
    assert results(df, X.cell_text(F.col("v"), dtype)) == [None if v is None else str(v) for v in values]
    assert results(df, X.text_or_empty(F.col("v"), dtype))[len(FLOATS) + 300] == ""


@pytest.mark.parametrize(
    "dtype, values",
    [
        ("boolean", [True, False, None]),
        ("int", [0, -7, None]),
        ("bigint", [2**60, None]),
        ("timestamp", [dt.datetime(2026, 3, 16), dt.datetime(2026, 3, 16, 1, 2, 3, 500000), None]),
        ("decimal(10,2)", [None]),
    ],
)
def test_text_of_other_types(spark, dtype, values):
    df = column(spark, values, dtype)
    got = results(df, X.cell_text(F.col("v"), df.schema["v"].dataType))
    assert got == [None if v is None else str(v) for v in values]


def test_a_date_is_read_as_midnight(spark):
    df = column(spark, [dt.date(2026, 3, 16)], "date")
    assert results(df, X.cell_text(F.col("v"), T.DateType())) == ["2026-03-16 00:00:00"]


def test_nested_types_have_no_text(spark):
    with pytest.raises(TypeError):
        X.cell_text(F.col("v"), T.ArrayType(T.StringType()))


def test_word_and_han_counts(spark):
    word = re.compile(r"\b[a-zA-Z]+(?:[\'\-][a-zA-Z]+)*\b")
    alphabet = "ab'-_9 éZ.字́٣²\n"
    rng = random.Random(3)
    values = ["hello world", "don't", "abc1", "it's-é", "a_b c", "well-known fact", "字典 cat", "", "don'té"]
    values += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = column(spark, values)
    assert results(df, X.count_units(F.col("v"), X.ENGLISH_WORDS)) == [len(word.findall(v)) for v in values]
    han = [len(re.findall(r"[一-龥]", v)) for v in values]
    assert results(df, X.count_units(F.col("v"), X.CHINESE_CHARS)) == han
    assert set(results(df, X.count_units(F.col("v"), "other"))) == {0}


def test_untranslated_text(spark):
    values = [None, "", "  ", "nan", " NaN ", "done", "0"]
    assert results(column(spark, values), X.is_untranslated(F.col("v"))) == [True] * 5 + [False] * 2


def _python_split(text, delimiters):
    found = [(text.find(d), i) for i, d in enumerate(delimiters) if d in text]
    if not found:
        return None
    at, i = min(found)
    body, payload = text[:at].strip(), text[at + len(delimiters[i]) :]
    return (body, delimiters[i] + payload, delimiters[i]) if body and payload.strip() else None


def test_split_affix(spark):
    rng = random.Random(11)
    values = ["Äpfel : rot", "茶壶·盖子", "p:q:r", ":x", "x:", "x: ", "plain", ""]
    values += ["".join(rng.choice("ab ·:#é") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    df = column(spark, values)
    for delimiters in (("·", ":"), (":",), ("::", ":"), (" :", ":")):
        got = with_halves(df, "v", delimiters).orderBy("nr").select(*HALVES).collect()
        assert [tuple(g) if g.delimiter else None for g in got] == [_python_split(v, delimiters) for v in values]
    assert _python_split("p:q:r", ("·", ":")) == ("p", ":q:r", ":")


def test_term_shape(spark):
    values = ["12", "a1", "_-_", "²", "٣", "12 é", "…", "字", "#13", "a###", "!!a", "𝒳!", "3.5\n"]
    df = column(spark, values)
    heavy = [bool(v.strip()) and bool(re.fullmatch(r"[0-9\W_]+", v.strip())) for v in values]
    assert results(df, X.is_symbol_or_number_heavy(F.col("v"))) == heavy
    noise = [sum(not c.isalnum() for c in v) / len(v) for v in values]
    assert results(df, X.noise_ratio(F.col("v"))) == noise


def test_normalize_and_dedup(spark):
    values = ["  A \t B　　C ", "x，y。", "İ", "ΑΣ", "ß"]
    df = column(spark, values)
    spaces = [re.sub(r"\s+", " ", v.strip()) for v in values]
    assert results(df, X.normalize_term(F.col("v"))) == spaces
    assert results(df, X.normalize_term(F.col("v"), trim=False, collapse_whitespace=False)) == values
    mapped = X.normalize_term(F.col("v"), punctuation={"，": ",", ",": ";", "。": "."})
    assert results(df, mapped)[1] == "x;y."
    assert results(df, X.dedup_key(F.col("v"), True)) == [v.lower() for v in values]
    assert results(df, X.dedup_key(F.col("v"), False)) == values


def test_key_predicates(spark):
    values = ["Color_A", "size", "draft_color", " color ", "Cølor"]
    df = column(spark, values)
    assert results(df, X.key_matches(F.col("v"), ("color",))) == [True, False, True, True, False]
    assert results(df, X.key_matches(F.col("v"), ("cØLOR", "SIZE"))) == [False, True, False, False, True]
    pattern = (r"^(?!draft)(?=.*color)",)
    assert results(df, X.key_matches(F.col("v"), pattern, regex=True)) == [True, False, False, True, False]
