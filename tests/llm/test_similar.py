"""Near copies of the pipeline's stage against all pairs."""

import random

import pytest
from llm_helpers import documents, lower_ascii

from keyweave.llm import similar, simhash


def plain_set(text):
    words = lower_ascii(text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The smallest doc_id of each component of pairs with a similarity of 0.8, by all pairs."""
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return set(least.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"other{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("crowded", [3, 32])
def test_one_of_each_group_by_similarity(spark, monkeypatch, crowded):
    monkeypatch.setattr(similar, "CROWDED", crowded)
    rng = random.Random(crowded)
    texts = [None, "", " \n", "One two", "one  TWO", "one two three"]
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        texts += [" ".join(edited(rng, base, rng.randrange(len(base) // 15))) for _ in range(rng.choice([2, 5, 45]))]
        texts += [" ".join(base[: len(base) - cut]) for cut in range(0, len(base) // 3, 7)]  # chains
        texts += [" ".join(base[:30] + [f"own{group}_{i}_{j}" for j in range(90)]) for i in range(4)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"] for r in simhash.one_of_each_group(documents(spark, rows)).collect()}
    assert got == plain_kept(rows)


def test_edited_copies_go_that_fingerprints_miss(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(edited(rng, base, n)) for n in (0, 1, 2, 3)]
    prints = [simhash.fingerprint(t) for t in texts]
    assert any((prints[0] ^ p).bit_count() > simhash.MOST_BITS for p in prints)
    assert [r["doc_id"] for r in simhash.one_of_each_group(documents(spark, texts)).collect()] == [0]


def test_fingerprints_find_copies_first(spark, monkeypatch):
    """Near copies within two bits go by their fingerprints alone; those that only look alike to a fingerprint stay."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(1500)]
    near = next(t for t in (" ".join(edited(rng, base, 1)) for _ in range(1000)) if within(t, " ".join(base)))
    far = " ".join(edited(rng, base, 25))
    loud = "x " * 800
    texts = [" ".join(base), near, far, " ".join(base).upper(), loud, loud + " ".join(f"own{i}" for i in range(300))]
    assert not within(far, texts[0]) and within(loud, texts[5])
    none = spark.createDataFrame([], "cell bigint, fp bigint, n int, at int")
    with monkeypatch.context() as patch:
        patch.setattr(similar, "_cells", lambda docs: none)
        assert kept_of(spark, texts) == {0, 2, 4, 5}
    assert kept_of(spark, texts) == plain_kept(list(enumerate(texts))) == {0, 4, 5}


def within(a, b):
    return (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() <= simhash.MOST_BITS


def kept_of(spark, texts):
    return {r["doc_id"] for r in simhash.one_of_each_group(documents(spark, texts)).collect()}


def test_linked_texts_are_not_compared_again(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (6, 1), (2, 1)], "a bigint, b bigint")
    group = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "fp bigint, group bigint")
    assert sorted(map(tuple, similar._across(pairs, group).collect())) == [(1, 3), (4, 5), (6, 1)]


def test_batches_for_python_are_small(spark, monkeypatch):
    """A batch of the stage has a bound in bytes, whatever the number of its rows."""
    monkeypatch.setattr(similar, "BATCH_BYTES", 10_000, raising=False)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(edited(rng, base, rng.randrange(9))) for _ in range(24)]
    docs, setting = documents(spark, texts).coalesce(1), "spark.sql.execution.arrow.maxBytesPerBatch"
    plain, before = type(docs).mapInArrow, spark.conf.get(setting)

    def watched(self, func, schema):
        def of_batches(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 20_000, batch.nbytes
                    yield batch

            return func(small())

        return plain(self, of_batches, schema)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    kept = {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()}
    simhash.near_duplicates(docs).collect()
    assert kept == plain_kept(list(enumerate(texts)))
    assert spark.conf.get(setting) == before
