"""Packing: shortest-pack-first over the length histogram.

Documents are encoded once; what is kept of a document are its pieces (place, length, CRC of
the ids), not the ids.  The packing itself sees only how many pieces there are of each length,
2048 numbers at most: lengths are placed longest first, each into the shortest packs that
have room, and packs of one pattern are counted, not listed.  Pieces get their rank from a
range sort by length, and a rank says which pack of which pattern a piece belongs to.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import travels_with_the_job
from keyweave.llm.tokens import END_OF_DOCUMENT, VOCABULARY, encoder
from keyweave.operators.sequence import numbered
from keyweave.session import materialize

travels_with_the_job(__name__)

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


def cut(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every document: full sequences from its start on, and what remains."""
    end = struct.pack("<I", END_OF_DOCUMENT)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(vocabulary).encoded
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoded(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, total))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(of_batches, PIECES)


@dataclass(frozen=True)
class Pattern:
    """``packs`` packs that hold the same pieces: (length, how many), longest first."""

    packs: int
    pieces: tuple[tuple[int, int], ...]


def patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Shortest-pack-first: where the pieces of each length go, as counts of patterns.

    Each piece goes to the shortest pack if it has room, else to a new one, which then is the
    shortest and takes as many more as it holds.
    """
    # Open packs: (-room, number of the pattern); the shortest pack has the most room.
    made: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    open_packs: list[tuple[int, int]] = []

    def put(packs: int, room: int, pieces: tuple[tuple[int, int], ...]) -> None:
        made.append((packs, pieces))
        heapq.heappush(open_packs, (-room, len(made) - 1))

    def with_more(pieces: tuple[tuple[int, int], ...], length: int, more: int):
        if pieces and pieces[-1][0] == length:
            return (*pieces[:-1], (length, pieces[-1][1] + more))
        return (*pieces, (length, more))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, at = heapq.heappop(open_packs)
                packs, pieces = made[at]
                filled = min(left, packs)
                made[at] = (0, ())
                if packs > filled:
                    put(packs - filled, -room, pieces)
                put(filled, -room - length, with_more(pieces, length, 1))
                left -= filled
            else:
                each = capacity // length
                if left >= each:
                    put(left // each, capacity - each * length, ((length, each),))
                if left % each:
                    put(1, capacity - left % each * length, ((length, left % each),))
                left = 0
    return [Pattern(packs, pieces) for packs, pieces in made if packs]


@dataclass(frozen=True)
class Places:
    """For runs of pieces in sort order: where the run starts and the place of its first piece."""

    first: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray


def places(found: list[Pattern], histogram: dict[int, int]) -> Places:
    """The runs for pieces sorted by length, shortest first."""
    before, next_rank = 0, {}
    for length in sorted(histogram):
        next_rank[length] = before
        before += histogram[length]
    rows, sequence = [], 0
    for pattern in found:
        offset = 0
        for length, each in pattern.pieces:
            rows.append((next_rank[length], length, sequence, offset, each))
            next_rank[length] += pattern.packs * each
            offset += length * each
        sequence += pattern.packs
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Places(*table.T)


def packed(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A NULL text is an empty one; every document ends with id 1, so an empty one has one id.
    Pieces are ranked by length, doc_id, start and CRC, doc_id NULL first; pieces equal in all of
    these are interchangeable.  Repeated rows are packed each.  An empty table gives an empty
    one.  A text of any length is encoded whole.
    """
    pieces = materialize(cut(docs, capacity, vocabulary), "pieces")
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    runs = places(patterns(histogram, capacity), histogram)
    ranked = numbered(pieces, ["length", "doc_id", "start", "ids_crc32"], "rank", start=0, label="ranked")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(5).to_numpy()
            run = np.searchsorted(runs.first, rank, side="right") - 1
            within = rank - runs.first[run]
            pack, slot = np.divmod(within, runs.each[run])
            columns = [
                *batch.columns[:5],
                pa.array(runs.sequence[run] + pack),
                pa.array(runs.offset[run] + slot * runs.length[run]),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    rows = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return rows.mapInArrow(of_batches, PACKED)
