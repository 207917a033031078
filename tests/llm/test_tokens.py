"""Encoding, token counts and packing against the tokenizer file itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import documents
from tokenizers import Tokenizer

from keyweave.llm import packing, token_counts
from keyweave.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def mixed_texts(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x85", "\x1c", " ", " ", "a", "the", "'s", "can't", "12", "--"]
    parts += ["é", "漢字", "😀", "<|endoftext|>", "²", "word", "Word."]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encoder = Encoder(cached_pieces=20)  # so small that both generations turn over
    for text in [None, "", " ", "a", "one two three\nfour", *mixed_texts(1500, 1)]:
        assert encoder.encoded(text) == np.array(ids(tokenizer, text), "<u4").tobytes()


def test_a_lone_surrogate_does_not_break_it():
    assert Encoder().encoded("a \ud800 b")


CORNERS = [None, "", "", " ", "same text", "same text", "long word " * 3000]


def test_counts_answer_every_limit(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    texts = [*CORNERS, *mixed_texts(200, 2)]
    lengths = [len(ids(tokenizer, t)) for t in texts]
    got = token_counts.counts_by_limit(documents(spark, texts)).collect()
    asked = {1 << k for k in range(20) if k == 0 or 1 << (k - 1) < max(lengths)}
    assert sorted(r["context_limit"] for r in got) == sorted({*lengths, *asked})
    for r in got:
        limit = r["context_limit"]
        assert r["asked"] == (limit in asked)
        assert r["n_docs"] == lengths.count(limit)
        assert r["n_docs_within"] == sum(n <= limit for n in lengths) == len(lengths) - r["n_docs_over"]
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths)
        assert r["total_tokens"] == sum(lengths)
    ordered = sorted(lengths)
    at_length = {p: r["context_limit"] for r in got for p in r["percentiles"]}
    assert at_length == {p: ordered[-(-p * len(ordered) // 100) - 1] for p in range(1, 101)}
    some = token_counts.counts_by_limit(documents(spark, texts), limits=[3, 10**6]).where("asked").collect()
    assert {r["context_limit"]: r["truncated_tokens"] for r in some} == {
        limit: sum(min(n, limit) for n in lengths) for limit in (3, 10**6)
    }
    assert token_counts.counts_by_limit(documents(spark, [])).count() == 0
    blank = token_counts.counts_by_limit(documents(spark, [None, ""])).orderBy("context_limit").collect()
    assert [(r["context_limit"], r["n_docs"], r["truncated_tokens"]) for r in blank] == [(0, 2, 0), (1, 0, 0)]


def test_patterns_hold_each_piece_once():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([8, 50, 2048])
        histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))}
        found = packing.patterns(histogram, capacity)
        held = defaultdict(int)
        for p in found:
            assert sum(length * each for length, each in p.pieces) <= capacity
            for length, each in p.pieces:
                held[length] += p.packs * each
        assert held == histogram


def one_by_one(lengths, capacity):
    """Shortest-pack-first, a piece at a time: the multiset of packs."""
    packs = []
    for length in sorted(lengths, reverse=True):
        shortest = min(packs, key=sum, default=None)
        if shortest is not None and sum(shortest) + length <= capacity:
            shortest.append(length)
        else:
            packs.append([length])
    return sorted(map(sum, packs))


def test_patterns_are_those_of_placing_one_by_one():
    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.choice([10, 40])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 60))]
        histogram = {n: lengths.count(n) for n in lengths}
        found = packing.patterns(histogram, capacity)
        sums = sorted(sum(n * e for n, e in p.pieces) for p in found for _ in range(p.packs))
        assert sums == one_by_one(lengths, capacity)


@pytest.mark.parametrize("capacity", [7, 2048])
def test_pieces_fill_sequences_without_gaps(spark, tokenizer, capacity):
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate([*CORNERS, *mixed_texts(120, 4)])]
    got = packing.packed(documents(spark, rows), capacity).collect()
    want = defaultdict(int)
    for doc_id, text in rows:
        whole = [*ids(tokenizer, text), 1]
        for start in range(0, len(whole), capacity):
            part = np.array(whole[start : start + capacity], "<u4").tobytes()
            want[doc_id, start, len(part) // 4, zlib.crc32(part), len(whole)] += 1
    sequences = defaultdict(list)
    for r in got:
        want[tuple(r)[:5]] -= 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert not any(want.values())
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.packed(documents(spark, []), capacity).count() == 0
