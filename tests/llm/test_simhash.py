import random

import pytest
from llm_helpers import plain_components, plain_fingerprint
from pyspark.sql import functions as F

from keyweave.llm import simhash
from keyweave.llm.components import connected


def of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_fingerprint_equals_the_plain_one():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one two", "ÄÖ ß É", "A\x1cb c\x0bd", "x " * 5000]
    texts += [" ".join(rng.choice(["a", "B", "cc", "é"]) for _ in range(n)) for n in range(1, 40)]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_hash_is_the_one_of_spark(spark):
    import xxhash

    got = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("a b é".encode(), seed=42)


def test_grid_keeps_every_pair_within_two_bits(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        fp = rng.getrandbits(64)
        pairs.append((fp, fp ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))))
    table = spark.createDataFrame([tuple(map(simhash._signed, p)) for p in pairs], "a bigint, b bigint")
    for r in table.select(simhash.grid_cells(F.col("a")), simhash.grid_cells(F.col("b"))).collect():
        assert set(r[0]) & set(r[1]) and len(set(r[0])) <= 33


def fingerprint_table(spark, fps):
    return spark.createDataFrame([(simhash._signed(x),) for x in sorted(set(fps))], "fp bigint")


@pytest.mark.parametrize("crowded", [2, 32])
def test_links_close_to_the_components_of_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(crowded)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):  # clusters, some of them dense, some chains
        fp = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            fps.append(fp)
            for _ in range(rng.randrange(1, 4)):
                fp ^= 1 << rng.randrange(rng.choice([6, 64]))
    fps = sorted(set(fps))
    links = connected(simhash.fingerprint_links(fingerprint_table(spark, fps))).collect()
    got = {r["node"]: r["component"] for r in links}
    want = plain_components(list(enumerate(fps)))
    groups = {}
    for fp, component in zip(fps, want, strict=True):
        signed = simhash._signed(fp)
        groups.setdefault(component, set()).add(got.get(signed, signed))
    assert all(len(found) == 1 for found in groups.values())
    assert len({next(iter(f)) for f in groups.values()}) == len(groups)


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(51), 0) | {200: 200, 201: 200}


def test_query_on_corners(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [
        (9, base), (4, base), (4, base), (None, base), (7, None), (8, ""), (3, " \n"), (11, "word"),
        (None, "alone here"), (12, "x y " * 30_000), (13, "x y " * 30_000),
    ]
    got = simhash.near_duplicates(of(spark, rows)).collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == sorted(
        (str(i), f"{plain_fingerprint(t):016x}", str(c)) for (i, t), c in zip(rows, want, strict=True)
    )
    assert simhash.near_duplicates(of(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (1, "z y x w v"), (None, "q r s t")]
    docs = of(spark, rows).withColumns({"fp": F.lit(1), "component": F.lit("c"), "hash": F.lit(2)})
    got = simhash.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [
        ("1", "z y x w v"), ("2", "a b c d"), ("None", "q r s t"),
    ]
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0
