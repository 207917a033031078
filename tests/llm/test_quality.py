import random

from llm_helpers import documents, plain_quality
from pyspark.sql import functions as F

from keyweave.llm import quality

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures_equal_the_plain_ones(spark):
    rng = random.Random(1)
    alphabet = ["a", "b", "c", "é", "#", "the", "\n", " ", "\t", "\x0b", "|", "x\x1cy", "😀"]
    texts = [None, "", " \n ", "a\na\n\na", "a b c a b c", "a b c d " * 8000, "a a a a"]
    texts += [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    got = quality.quality_of_documents(documents(spark, texts)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        want = plain_quality(text)
        assert tuple(row[n] for n in NAMES) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row["base_failed"] and row["kept"])


def test_prose_stays_and_junk_goes(spark):
    rng = random.Random(2)
    words = [w for w in quality.STOP_WORDS if w.isalpha()] + [f"word{i}" for i in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(300))
    symbols = " ".join(f"word{i}%%%" for i in range(300))
    cells = " | ".join(f"cell{i}" for i in range(300))
    rows = [(1, prose), (2, symbols), (3, cells), (4, "the of " * 100), (5, None), (5, prose)]
    docs = documents(spark, rows).withColumns({"kept": F.lit("k"), "verdict": F.lit(1)})
    got = quality.kept(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 5]
    assert quality.kept(docs.limit(0)).count() == 0


def test_rules_are_a_table(spark):
    docs = documents(spark, ["a b c", "a b", None])
    rule = quality.Rule("short", "n_words", least=3)
    got = docs.select("doc_id", quality.verdict(F.col("text"), [], [rule]).alias("v")).orderBy("doc_id").collect()
    assert [r["v"]["broken"] for r in got] == [[], ["short"], ["short"]]
    assert docs.select(quality.verdict(F.col("text"), [], [])["kept"]).distinct().collect() == [(True,)]


def test_plan_has_neither_python_nor_shuffle(spark):
    plan = quality.quality_of_documents(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clean_documents_stay_whatever_their_length_case_or_language(spark):
    rng = random.Random(4)
    words = ["the", "of", "and", "to"] + [f"word{i}" for i in range(3000)]
    prose = " ".join(rng.choice(words[:4] if rng.random() < 0.3 else words) for _ in range(6000))
    russian = " ".join(rng.choice("абвгде") + rng.choice("жзиклм") + str(i % 97) for i in range(300))
    docs = documents(spark, [(1, prose), (2, prose[:3000].upper())])
    other = documents(spark, [(3, russian)], "ru").union(documents(spark, [(4, russian)], "en"))
    every = docs.union(other)
    assert sorted(r["doc_id"] for r in quality.kept(every).collect()) == [1, 2, 3]
    judged = quality.quality_of_documents(every).where("kept").collect()
    assert sorted(r["doc_id"] for r in judged) == [1, 2, 3]
    for lang, stays in (("EN-gb", False), (None, False), ("nl", True), ("fro", True)):
        assert (quality.kept(documents(spark, [russian], lang)).count() == 1) == stays
    without = documents(spark, [(1, prose), (4, russian)]).drop("lang")
    assert [r["doc_id"] for r in quality.kept(without).collect()] == [1]
