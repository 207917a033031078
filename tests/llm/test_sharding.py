import random
import zlib
from collections import Counter, defaultdict

import pytest
from llm_helpers import documents

from keyweave.llm import sharding


def test_walk_fills_every_bound_once():
    rng = random.Random(4)
    for case in range(30):
        shards, points = rng.randrange(1, 6), rng.randrange(1, 6)
        arcs = [(a, s) for a, s in enumerate(rng.sample([s for s in range(shards)] * points, shards * points))]
        loads = {a: rng.choice([0, 0, 1, 5, 40]) for a, _ in arcs}
        pieces = sharding.walk(arcs, loads, shards)
        total = sum(loads.values())
        per_shard, per_arc = defaultdict(list), defaultdict(list)
        for p in pieces:
            per_shard[p.shard].append((p.slot, p.rows))
            per_arc[p.arc].append((p.first_rank, p.rows))
        for found, sizes in (
            (per_shard, {s: total // shards + (s < total % shards) for s in range(shards)}),
            (per_arc, loads),
        ):
            for key, size in sizes.items():
                at = 0
                for start, rows in sorted(found.get(key, [])):
                    assert start == at
                    at += rows
                assert at == size, case


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_rows_are_even_and_slots_gapless(spark, shards):
    rng = random.Random(shards)
    texts = [None, "", "é" * 70_000] + ["same text"] * 150 + [f"t{rng.randrange(200)}" for _ in range(300)]
    rows = [(None if i % 50 == 0 else i % 400, t) for i, t in enumerate(texts)]
    got = sharding.sharded(documents(spark, rows), shards).collect()
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == Counter(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rows_stay_where_they_are_when_a_shard_has_room(spark):
    docs = documents(spark, [f"text {i}" for i in range(2000)])
    moved = [r["moved"] for r in sharding.sharded(docs, 8, 512).collect()]
    assert sum(moved) < 0.2 * len(moved)


def test_empty_table(spark):
    assert sharding.shards_of_documents(documents(spark, [])).count() == 0


def walked_by_document(rows, places, shards):
    """Every document by itself: its place on the ring, then clockwise to the next shard with room, all in step.

    rows: (key, crc, size, doc_id) of each document; places: (hash, shard), clockwise.
    """
    total = len(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    held, waiting = defaultdict(list), []
    arcs = [[] for _ in places]
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or 0)):
        arcs[sum(place < row[0] for place, _ in places) % len(places)].append(row)
    bounds = [place for place, _ in places]
    # Those past the last place come before those at the beginning of the ring.
    arcs[0].sort(key=lambda r: r[0] <= bounds[-1])
    for at, (_, shard) in enumerate(places):
        fits = room[shard] - len(held[shard])
        held[shard] += arcs[at][:fits]
        if arcs[at][fits:]:
            waiting.append((at, arcs[at][fits:]))
    while waiting:
        at, rest = waiting.pop(0)
        while len(held[places[at][1]]) >= room[places[at][1]]:
            at = (at + 1) % len(places)
        shard = places[at][1]
        fits = room[shard] - len(held[shard])
        held[shard] += rest[:fits]
        if rest[fits:]:
            waiting.append((at, rest[fits:]))
    return {shard: sorted(rows, key=str) for shard, rows in held.items() if rows}


@pytest.mark.parametrize("shards, points", [(3, 2), (5, 8)])
def test_shards_equal_a_walk_of_single_documents(spark, shards, points):
    rng = random.Random(shards)
    texts = ["same"] * 120 + [f"t{rng.randrange(150)}" for _ in range(300)] + [None, ""]
    docs = documents(spark, texts)
    keys = {r["doc_id"]: r["key"] for r in docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS key").collect()}
    places = sorted(tuple(r) for r in sharding.ring(spark, shards, points).collect())
    rows = [(keys[i], zlib.crc32((t or "").encode()), len((t or "").encode()) + 16, i) for i, t in enumerate(texts)]
    got = defaultdict(list)
    for r in sharding.sharded(docs, shards, points).collect():
        got[r["shard"]].append((keys[r["doc_id"]], r["text_crc32"], r["size"], r["doc_id"]))
    assert {s: sorted(x, key=str) for s, x in got.items()} == walked_by_document(rows, places, shards)


def test_one_more_shard_moves_few_rows(spark):
    docs = documents(spark, [f"text {i}" for i in range(3000)])
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.sharded(docs, n).collect()} for n in (20, 21))
    changed = [i for i in before if before[i] != after[i]]
    between_old = [i for i in changed if after[i] != 20]
    assert len(changed) < 0.15 * len(before) and len(between_old) < 0.08 * len(before)
