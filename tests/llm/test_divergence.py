import random
import re
from collections import Counter, defaultdict

import pytest
from llm_helpers import DOCUMENT, lower_ascii

from keyweave.llm.divergence import Settings, kept_terms, source_divergence

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ROW = ("lang", "source", "part", "item", "value", "rank")


def plain_divergence(docs, least=10, top=10):
    """docs: (text, lang, source).  The rows by adding everything up in dictionaries."""
    docs = [(TERMS.findall(lower_ascii(t or "")), lang or "", source or "") for t, lang, source in docs]
    rows = []
    for lang in {d[1] for d in docs}:
        own = [(words, source) for words, of, source in docs if of == lang]
        often = Counter(w for words, _ in own for w in set(words))
        kept = [w for w in often if often[w] >= least]
        counts = defaultdict(Counter)
        for words, source in own:
            counts[source].update(w for w in words if often[w] >= least)
        pool = sum(counts.values(), Counter())

        def share(count, w, v=len(kept)):
            return 1 + 1_000_000_000 * (count[w] + 2) // (sum(count.values()) + 2 * v)

        def difference(p, q):
            return (p - q) ** 2 // (p + q)

        for source, count in counts.items():
            pairs = [
                (-sum(difference(share(count, w), share(counts[o], w)) for w in kept), o.encode(), o)
                for o in counts
                if o != source
            ]
            above = [w for w in kept if count[w] and share(count, w) > share(pool, w)]
            terms = [(-difference(share(count, w), share(pool, w)), w.encode(), w) for w in above]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                rows += [(lang, source, part, o, -v, rank) for rank, (v, _, o) in enumerate(found, 1)]
    return sorted(rows)


def table(spark, docs):
    return spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(docs)], DOCUMENT)


def got(df):
    return sorted(tuple(r) for r in df.select(*ROW).collect())


def some_docs(rng, n):
    words = [rng.choice("abé") * rng.randrange(1, 5) + rng.choice(["", "Z", "ßß", "x" * 40]) for _ in range(60)]
    words += ["longest" * k + "x" for k in range(1, 12)] + ["日本語", "日本語学", "日本", "ABC", "abc"]
    docs = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", "", None]), rng.choice(["s0", "s0", "s1", "s2", "é", None])
        several = [rng.choice(words) + rng.choice(["", ".", "1", "\x00", "_"]) for _ in range(rng.randrange(30))]
        docs.append((rng.choice([" ".join(several), "".join(several), None, ""]), lang, source))
    return docs


@pytest.mark.parametrize(
    "settings",
    [Settings(), Settings(least_documents=3, first_bytes=1, table_bits=15, most_held=7, block_cells=4, top_terms=2)],
)
def test_equals_adding_up_in_dictionaries(spark, settings):
    docs = some_docs(random.Random(settings.first_bytes), 400)
    want = plain_divergence(docs, settings.least_documents, settings.top_terms)
    assert {r[2] for r in want} == {"pair", "term"}
    assert got(source_divergence(table(spark, docs), settings)) == want


def test_long_terms_are_refined_to_the_end(spark):
    """Terms of several levels, one the prefix of another; a long common prefix of terms that are too rare."""
    long = "y" * 300
    docs = [(f"{long} {long}z {long[:7]}", "en", "a")] * 10 + [(f"{long}q" + "r" * i, "en", "b") for i in range(40)]
    found = {(r["lang"], bytes(r["item"]).decode(), r["docs"]) for r in kept_terms(table(spark, docs)).collect()}
    assert found == {("en", long, 10), ("en", long + "z", 10), ("en", long[:7], 10)}


def test_sources_without_kept_terms(spark):
    """A language without kept terms, a source without terms, a source alone in its language, ties."""
    docs = [("one two", "de", s) for s in ("a", "b", None)] + [("w " * 3, "en", "s")] * 9 + [("w v", "en", "t")] * 9
    docs += [(None, "en", "empty"), ("same words", "fr", "only")] + [("b a", "tie", f"s{i}") for i in range(12)]
    rows = got(source_divergence(table(spark, docs)))
    assert rows == plain_divergence(docs)
    assert [r[3:] for r in rows if r[:3] == ("de", "a", "pair")] == [("", 0, 1), ("b", 0, 2)]
    assert not [r for r in rows if r[0] == "fr"]


def test_corners(spark):
    """No rows; other column types; columns with the names that the operator uses inside."""
    assert source_divergence(table(spark, [])).collect() == []
    plain = [("w u", "en", "1")] * 10 + [("w", "en", "2")] * 10
    frame = spark.createDataFrame([(t, lang, int(s)) for t, lang, s in plain], "text string, lang string, source int")
    frame = frame.selectExpr("*", "1 AS item", "2 AS docs", "3 AS n", "4 AS block", "5 AS total")
    assert got(source_divergence(frame)) == plain_divergence(plain)
    great = Settings(least_documents=1, scale=1_000_000_000)
    many = spark.createDataFrame([("a " * 50_000, "en", "s"), ("b", "en", "t")], "text string, lang string, source string")
    assert got(source_divergence(many, great)) == plain_divergence([("a " * 50_000, "en", "s"), ("b", "en", "t")], 1)
