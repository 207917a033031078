"""Language ID, toxicity and license scans: held-out accuracy, corners, plain versions."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from llm_helpers import crc, documents, lower_ascii
from pyspark.sql import functions as F

from keyweave.llm import langid, licenses, toxicity

STEMS = {
    "xx": ["ka", "lo", "mi", "ren", "sut", "po", "tal"],
    "yy": ["zha", "xor", "quin", "vyk", "jub", "wex"],
    "zz": ["éa", "ñu", "öre", "çu", "ãi", "üli"],
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def language_table(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, rng.randrange(5, 80)), lang) for i, lang in enumerate(sorted(STEMS) * 80)]
    rows += [(1001, None, "xx"), (1002, "", "yy"), (1003, "12 -- ²", "xx"), (None, prose(rng, "zz", 30), None)]
    rows += [(1004, prose(rng, "xx", 30_000), None), (1004, "ka lo", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = language_table(spark)
    got = langid.languages_of_documents(docs.withColumn("score", F.lit("s"))).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or crc(r["doc_id"]) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1001, 1002, 1003):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    seen = [r for r in got if r["held_out"] and r["doc_id"] and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in seen) >= 0.98 * len(seen)
    kept = langid.identified(docs.withColumn("rejected", F.lit(1)))
    assert kept.columns == [*docs.columns, "rejected"]
    assert not {1001, 1002, 1003} & {r["doc_id"] for r in kept.collect()}
    assert kept.count() >= docs.count() - 4


def test_labels_of_held_out_rows_and_other_columns_are_not_learned(spark):
    docs = language_table(spark)
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id"), 3, 1), F.lit("wrong")).otherwise(F.col("lang")))

    def answers(d):
        return {(str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in langid.languages_of_documents(d).collect()}

    assert answers(docs) == answers(other)


def test_language_without_rows_or_labels(spark):
    assert langid.languages_of_documents(documents(spark, [])).count() == 0
    got = langid.languages_of_documents(documents(spark, ["abc", None], lang=None)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_examples_are_the_gram_counts_of_the_sample_in_order(spark):
    texts = ["ka lo " * 300, "zha", "é ñu", "a" * 70_000, "12", "mi"]
    drawn = [("yy" if i % 2 else "xx", i / 10, text) for i, text in enumerate(texts)]
    sample = spark.createDataFrame([(text, lang, draw) for lang, draw, text in reversed(drawn)], "text string, lang string, draw double")
    with langid._features(sample, langid.Settings(sample_rows=4, rows_at_once=2)) as got:
        plain = [(lang, langid.gram_counts(text)) for lang, _, text in sorted(drawn) if text != "12"]
        assert got.langs == [lang for lang, _ in plain] and len(got) == len(plain)
        for i, (lang, counts) in enumerate(plain):
            found, at, weights = got[i]
            assert found == lang and at.tolist() == np.flatnonzero(counts).tolist()
            assert weights.tolist() == (counts[at] / counts.sum()).astype("f4").tolist()


def test_the_sample_is_never_whole_in_the_drivers_memory(spark):
    text = "array_join(transform(sequence(1, 2000), i -> sha2(concat(id, '-', i), 256)), '')"
    docs = spark.range(240).selectExpr("id AS doc_id", f"{text} AS text", "IF(id % 2 = 0, 'xx', 'yy') AS lang")
    tracemalloc.start()
    try:
        assert langid.trained(docs, langid.Settings(epochs=1)).languages == ("xx", "yy")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 160 rows of almost all 32,768 buckets; in memory at 8 bytes each they take 40 MB.
    assert peak < 20e6


BAD = ["grumbul", "snarkel", "frobnik"]


def toxic_tables(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.choice(["xx", "yy"]), rng.randrange(20, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "ka", "mi", "s"]))
        rows.append((i, " ".join(words)))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    rows += [(2001, None), (2002, ""), (2003, "12 !"), (None, "grumbul ka"), (5, rows[5][1]), (2004, "ka lo " * 20_000)]
    labels += [(0, 1, 0), (2, 0, None), (None, 1, 1), (99_999, 1, 1)]
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_toxic_rows_are_found_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.toxicity_of_documents(docs.withColumn("toxic", F.lit(9)), labels).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 4 == 2)
    asked = [i for i in range(900) if crc(i) % 4 == 2]
    right = sum(by_id[i]["predicted"] == (i % 6 == 0) for i in asked)
    assert right >= 0.98 * len(asked)
    assert all(by_id[i]["predicted"] == 0 for i in (2001, 2002, 2003, 2004))


def test_a_lexicon_too_large_to_broadcast_is_joined(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.trained(docs, labels)
    assert model.broadcast

    def evidence(m):
        return {(str(r["doc_id"]), round(r["evidence"], 9)) for r in toxicity.scored(docs, m).collect()}

    joined = toxicity.Model(model.lexicon, False, model.slope, model.shift)
    assert evidence(model) == evidence(joined)
    small = toxicity.Settings(most_broadcast=1, most_broadcast_labels=1)
    assert not toxicity.trained(docs, labels, small).broadcast


def plain_ratio(counts, word, margin):
    """The ratio of a word, followed while the toxic model knows the beginning."""
    from math import log

    beginnings = ({}, {})
    for label in (0, 1):
        for w, n in counts[label].items():
            form = toxicity.form_of(w)
            for end in range(1, len(form) + 1):
                beginnings[label][form[:end]] = beginnings[label].get(form[:end], 0) + n
    every = set(beginnings[0]) | set(beginnings[1])
    lasts, pairs = {}, {}
    for p in every:
        lasts[p[-1]] = lasts.get(p[-1], 0) + 1
        if len(p) > 1:
            pairs[p[-2:]] = pairs.get(p[-2:], 0) + 1

    def shared(p):
        base = (lasts[p[-1]] + 0.5) / (len(every) + 0.5 * (len(lasts) + 1))
        if len(p) == 1:
            return base
        after = {q: n for q, n in pairs.items() if q[0] == p[-2]}
        return (pairs[p[-2:]] - 0.75 + 0.75 * len(after) * base) / sum(after.values())

    def of_class(label, p):
        after = {q: n for q, n in beginnings[label].items() if q[:-1] == p[:-1]}
        if not after:
            return shared(p)
        held = max(after.get(p, 0) - 0.75, 0) + 0.75 * len(after) * shared(p)
        return held / sum(after.values())

    form, total = toxicity.form_of(word), 0.0
    for end in range(1, len(form) + 1):
        p = form[:end]
        if p in every:
            total += log(of_class(1, p) / of_class(0, p))
        else:
            passed = []
            for label in (1, 0):
                after = [n for q, n in beginnings[label].items() if q[:-1] == p[:-1]]
                passed.append(0.75 * len(after) / sum(after) if after else 1)
            total += log(passed[0] / passed[1])
        if p not in beginnings[1]:
            break
    return max(0.0, total - margin)


def test_word_scores_equal_the_plain_ones(spark):
    texts = [(0, "ka lo kalo mi mika lokami"), (0, "ka ka lo grant"), (1, "grumbul ka gru grumb kalo"), (1, "grumbul")]
    rows = spark.createDataFrame([(t, x) for x, t in texts], "text string, toxic int")
    counts = ({}, {})
    for label, text in texts:
        for w in text.split():
            counts[label][w] = counts[label].get(w, 0) + 1
    table = toxicity._pruned(toxicity.lexicon(rows, 0.2).toArrow(), 0.2)
    scores = toxicity.WordScores(table, 0.2)
    for word in "grumbul grumbulka grum gru g ka kalo grant grantx zz mikael lokami gran".split():
        assert scores[word] == pytest.approx(plain_ratio(counts, word, 0.2)), word


def test_more_labelled_rows_than_the_curve_needs_are_counted(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id")
    for n, share in ((100, 1 / 5), (4000, 1 / 5), (1_000_000, 20_000 / 1_000_000)):
        drawn = rows.where(toxicity._for_curve(toxicity.Settings(), n)).count()
        assert abs(drawn / 4000 - share) < 0.03


def test_more_languages_than_the_model_holds_are_an_error(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(40)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 9))
    with pytest.raises(ValueError, match="more than 3 values"):
        langid.trained(docs, langid.Settings(most_languages=3))
    assert langid.identified(docs.limit(0)).collect() == []


def test_toxicity_without_rows_or_labels(spark):
    docs, labels = toxic_tables(spark)
    assert toxicity.toxicity_of_documents(docs.limit(0), labels).count() == 0
    got = toxicity.toxicity_of_documents(docs, labels.limit(0)).collect()
    assert len(got) == docs.count() and not any(r["predicted"] for r in got)


LICENSE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words = LICENSE_WORDS.findall(lower_ascii(text or ""))
    found = [
        (i, label)
        for i in range(len(words))
        for phrase, label in licenses.BASE_PHRASES.items()
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


def license_texts():
    rng = random.Random(12)
    parts = ["CC BY", "cc-by", "ccby", "General Public\nLicense", "All rights reserved.", "é", "12", "x_y", "by", "cc"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(150)]
    return [None, "", "...", "cc by cc by cc by", *texts, "word " * 50_000 + "All Rights Reserved"]


def test_base_places_equal_the_plain_ones(spark):
    texts = license_texts()
    got = licenses.scanned(documents(spark, texts).withColumn("labels", F.lit(1))).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert tuple(r)[1:6] == plain_base(text)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: t.label)
def test_every_template_is_found_anywhere(spark, template):
    index = licenses.Index(licenses.TEMPLATES, 0, {})
    settings = licenses.Settings()
    for text in (template.text, f"Some words. {template.text.upper()}! More.", "is not a text " * 999 + template.text):
        assert template.label in index.matches(licenses.license_words(text), settings)
    without = template.text.replace(template.phrase.split()[-1], "other")
    assert template.label not in index.matches(licenses.license_words(without), settings)
    assert index.matches(licenses.license_words("plain prose under the version of the software"), settings) == {}


def test_license_words_are_counted_over_all_documents(spark):
    docs = documents(spark, ["mit license", "license license", None, "prose"])
    n, frequency = licenses.template_frequency(docs)
    assert (n, frequency[b"license"], frequency[b"mit"]) == (4, 2, 1)
    assert licenses.scanned(docs.limit(0)).count() == 0
