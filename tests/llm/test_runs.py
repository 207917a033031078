import hashlib
import random
import zlib

import pytest
from llm_helpers import SPACE_WORDS, documents

from keyweave.llm.runs import Settings, collapsed, periodic_runs, run_digests, runs_of_words


def plain_runs(words, least_words=24, least_periods=3):
    """All maximal stretches by comparing the words with themselves, shifted."""
    found = []
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = (all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if j > i and length >= max(least_words, least_periods * q) and not any(smaller):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = SPACE_WORDS.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, period = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = (None, None, None, None)
    for start, length, q in found:
        if best[1] is None or length * best[2] > best[1] * q:
            best = (start, length, q, 1000 * length // q)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)))


def periodic_words(rng):
    size = rng.choice([1, 2, 2, 3, 5, 50])
    words = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(160))]
    for _ in range(rng.randrange(4)):
        unit = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(1, 20))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = [unit[i % len(unit)] for i in range(rng.randrange(10, 120))]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "w0"
    return words


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_comparing_all_shifts(seed):
    rng = random.Random(seed)
    for _ in range(200):
        words = periodic_words(rng)
        assert runs_of_words(words) == plain_runs(words), words


def test_own_settings():
    words = "x " + "a b c " * 12 + "a y"
    assert runs_of_words(words.split(), Settings(least_words=30)) == [(1, 37, 3)]
    assert runs_of_words(words.split(), Settings(least_words=38)) == []
    assert runs_of_words(words.split(), Settings(least_periods=13)) == []
    for settings in ({"least_words": 23}, {"least_periods": 2}):
        with pytest.raises(ValueError):
            Settings(**settings)


def test_overlapping_runs_and_what_is_kept():
    words = ["a"] * 30 + ["b", "a"] * 15
    found = runs_of_words(words)
    assert found == [(0, 30, 1), (29, 31, 2)]
    assert collapsed(words, found) == ["a", "b"]


def test_long_periods_and_long_texts():
    words = [str(i % 1000) for i in range(20_000)]
    assert runs_of_words(words) == [(0, 20_000, 1000)]
    assert runs_of_words(["x"] * 50_000) == [(0, 50_000, 1)]


def test_query_equals_the_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "a " * 24, "a " * 23, "A a " * 20, "é é " * 30]
    texts += [" ".join(periodic_words(rng)) for _ in range(150)]
    texts += [" \n".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(400))) for _ in range(100)]
    got = [tuple(r) for r in run_digests(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [plain_row(i, t) for i, t in enumerate(texts)]
    assert sum(r[1] > 0 for r in got) > 50


def test_corners(spark):
    """NULL ids, repeated rows, ids that are numbers of other types, clashing columns, no rows."""
    table = documents(spark, [(None, "b " * 30), (None, "b " * 30), (7, None), (7, None)])
    table = table.selectExpr("*", "1 AS runs", "2 AS n_words", "3 AS _text", "4 AS collapsed", "5 AS best")
    got = sorted((tuple(r) for r in run_digests(table).collect()), key=str)
    assert got == sorted((plain_row(i, t) for i, t in [(None, "b " * 30)] * 2 + [(7, None)] * 2), key=str)
    spans = periodic_runs(documents(spark, ["x " + "a b " * 20]), ["doc_id", "source"]).first()
    assert spans.asDict(recursive=True) == {
        "doc_id": 0,
        "source": "s",
        "n_words": 41,
        "runs": [{"start": 1, "length": 40, "period": 2}],
        "collapsed": "x a b",
    }
    assert run_digests(documents(spark, [])).collect() == []
    small = spark.createDataFrame([(3, "t t")], "doc_id int, text string")
    assert [tuple(r) for r in run_digests(small).collect()] == [plain_row(3, "t t")]
