import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
import regex
from llm_helpers import documents

from keyweave.llm.imatch import Settings, edited_fingerprints, fingerprinted, lexicon, likeness

TERMS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_lexicon(texts, s=Settings()):
    often = Counter(t for text in texts for t in set(TERMS.findall((text or "").lower())))
    return {t for t, n in often.items() if s.lowest_idf <= math.log(len(texts) / n) <= s.highest_idf}


def plain_fingerprint(text, known, levels=5):
    by_subset = defaultdict(set)
    for term in set(TERMS.findall(text.lower())) & known:
        for level in range(levels):
            drawn = int(md5(term)[4 * level : 4 * level + 4], 16) % (16 << 2 * level)
            if drawn < 16:
                by_subset[f"{drawn + 16 * level:02x}"].add(term)
    if by_subset:
        return "".join(subset + md5(" ".join(sorted(by_subset[subset])))[:8] for subset in sorted(by_subset))
    return "".join(name + md5(text)[8 * i : 8 * i + 8] for i, name in enumerate(["fc", "fd", "fe", "ff"]))


def plain_likeness(a, b):
    a, b = ({f[i : i + 10] for i in range(0, len(f), 10)} for f in (a, b))
    either = {e[:2] for e in a | b}
    levels = sorted({s[0] for s in either})
    shares = [sum(e[0] == x for e in a & b) / sum(s[0] == x for s in either) for x in levels]
    return sum(shares) / len(levels)


def plain_rows(rows, s=Settings()):
    """rows: (doc_id, text) in order."""
    known = plain_lexicon([t for _, t in rows], s)
    found = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (plain_fingerprint(t, known, s.levels) for t in (text, edited, following))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        found.append((doc_id, len(text), digest, a, b, plain_likeness(a, b), plain_likeness(a, c)))
    return found


def some_texts(rng, n):
    words = [rng.choice("aéZß日") * rng.randrange(1, 4) + str(rng.randrange(40)) for _ in range(150)]
    texts = [
        rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        for _ in range(n)
    ]
    for _ in range(n // 8):
        texts[rng.randrange(n)] = texts[rng.randrange(n)]
    return [*texts, None, "", " \n", "unheard-of", "🤦🏼‍♂️ emoji 🤦🏼‍♂️"]


@pytest.mark.parametrize("settings", [Settings(), Settings(0.5, 2.5, 2), Settings(most_broadcast=0)])
def test_equals_the_plain_version(spark, settings):
    texts = some_texts(random.Random(5), 120)
    got = [tuple(r) for r in edited_fingerprints(documents(spark, texts), settings).orderBy("doc_id").collect()]
    want = plain_rows(list(enumerate(texts)), settings)
    assert got == want
    assert len({r[3] for r in got}) > 50


def test_likeness_follows_what_is_shared(spark):
    """Half edited texts are nearer to their origin than texts of other words, at any length; copies are equal."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(20_000)]
    for n in (30, 300, 3000):
        texts = [" ".join(rng.sample(words, n)) for _ in range(40)]
        table = documents(spark, [*texts, texts[-1]])
        rows = edited_fingerprints(table, Settings(0.0, 20.0)).orderBy("doc_id").collect()
        near = sum(r["near_edited"] for r in rows) / len(rows)
        far = sum(r["near_next"] for r in rows[:39]) / 39
        assert near > 0.05 and near > 5 * far, (n, near, far)
        assert rows[39]["near_next"] == 1.0 and rows[39]["fingerprint"] == rows[40]["fingerprint"]


def test_order_of_equal_and_missing_ids(spark):
    """NULL ids first, equal rows follow each other, a row that is alone is its own next."""
    rows = [(5, "b c"), (None, "x y"), (5, "b c"), (5, "b c"), (2, None), (None, "x y")]
    got = sorted((tuple(r) for r in edited_fingerprints(documents(spark, rows)).collect()), key=str)
    ordered = [(None, "x y")] * 2 + [(2, None)] + [(5, "b c")] * 3
    assert got == sorted(plain_rows(ordered), key=str)
    alone = edited_fingerprints(documents(spark, [(1, "only one")])).collect()
    assert [tuple(r) for r in alone] == plain_rows([(1, "only one")])
    assert edited_fingerprints(documents(spark, [])).collect() == []


def test_clashing_columns_and_own_tables(spark):
    table = documents(spark, ["a b c", "a b", "q"]).selectExpr("*", "1 AS id", "2 AS hash", "'x' AS term", "3 AS n", "4 AS once")
    got = [tuple(r) for r in edited_fingerprints(table).orderBy("doc_id").collect()]
    assert got == plain_rows([(0, "a b c"), (1, "a b"), (2, "q")])
    wide = Settings(0.0, 9.0)
    known = lexicon(table, wide)
    assert {r["term"] for r in known.collect()} == {"a", "b", "c", "q"}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprinted(table, known, ["doc_id"], ["source"], wide).collect()}
    assert prints == {i: plain_fingerprint(t, set("abcq")) for i, t in enumerate(["a b c", "a b", "q"])}
    both = spark.createDataFrame([(prints[0], prints[1])], "a string, b string")
    assert both.select(likeness(both["a"], both["b"])).first()[0] == plain_likeness(prints[0], prints[1])
