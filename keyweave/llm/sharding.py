"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``points`` places on a ring of 64-bit hashes; a document's key is the hash
of its text, so equal texts start at one place.  A key belongs to the next place clockwise.
A shard takes rows up to its bound and no more; the rows beyond it continue clockwise to the
next place whose shard has room.  The bounds are the row count divided evenly, so shards
differ by one row at most, and a key moves only as far as the full shards on its way.

The walk around the ring is done on row counts per arc: a table of ``shards * points`` rows
at most, whatever the number of documents.  Its outcome is a list of rank ranges per arc,
of at most one range per arc and one more per shard that fills up; documents join it by arc
and rank.  Ranks come from a range sort, so no arc is gathered, even if a third of all rows
have one text.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm.columns import bigint_array
from keyweave.operators.sequence import numbered


@dataclass(frozen=True)
class Piece:
    """Rows of one arc, by rank, that go to one shard from ``slot`` on."""

    arc: int
    first_rank: int
    rows: int
    shard: int
    slot: int


def ring(spark: SparkSession, shards: int, points: int) -> DataFrame:
    """The places on the ring: ``place`` (signed 64-bit hash) and ``shard``, sorted clockwise."""
    ids = spark.range(shards * points)
    shard, point = (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)
    return ids.select(F.xxhash64(F.lit("shard"), shard, point).alias("place"), shard.alias("shard"))


def walk(arcs: list[tuple[int, int]], loads: dict[int, int], shards: int) -> list[Piece]:
    """Where the rows of each arc go.

    ``arcs`` are (arc, shard) clockwise; ``loads`` the rows that start in each arc.  First each
    place takes what it can of its own arc, clockwise; then what is left over moves on,
    place by place, all arcs in step, until it finds room.  The bounds add up to the row
    count, so one turn is enough.
    """
    total = sum(loads.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    filled = [0] * shards
    pieces: list[Piece] = []
    rank = dict.fromkeys((arc for arc, _ in arcs), 0)

    def take(arc: int, shard: int, waiting: int) -> int:
        """Rows of ``waiting`` that do not fit."""
        fits = min(waiting, room[shard] - filled[shard])
        if fits:
            pieces.append(Piece(arc, rank[arc], fits, shard, filled[shard]))
            rank[arc] += fits
            filled[shard] += fits
        return waiting - fits

    left = {arc: take(arc, shard, loads.get(arc, 0)) for arc, shard in arcs}
    waiting = deque((at, arc) for at, (arc, _) in enumerate(arcs) if left[arc])
    # A shard that is full stays full, so the next place with room is remembered.
    n = len(arcs)
    skip = list(range(1, n + 1))

    def next_with_room(at: int) -> int:
        seen = []
        at = skip[at] % n
        while filled[arcs[at][1]] >= room[arcs[at][1]]:
            seen.append(at)
            at = skip[at] % n
        for place in seen:
            skip[place] = at if at > place else at + n
        return at

    while waiting:
        at, arc = waiting.popleft()
        to = next_with_room(at)
        left[arc] = take(arc, arcs[to][1], left[arc])
        if left[arc]:
            waiting.append((to, arc))
    return pieces


def sharded(
    docs: DataFrame,
    shards: int = 40,
    points: int = 64,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot, arc, moved.

    Size is the UTF-8 length of the text plus 16, 16 for NULL; a NULL text has the CRC of an
    empty one.  ``slot`` runs from 0 without gaps in each shard.  ``moved`` says that the row
    overflowed.  Ties are broken by doc_id, NULL first; rows equal in all of this are
    interchangeable.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    clean = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(clean) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(clean, "UTF-8")).alias("text_crc32"),
        F.xxhash64(clean).alias("key"),
    )
    places = sorted(tuple(r) for r in ring(spark, shards, points).collect())  # shards * points rows
    bounds = [place for place, _ in places]
    ranked = numbered(rows, ["key", "text_crc32", "size", "doc_id"], "rank", start=0, label="ring")

    # The arc of a key is the number of places before it, found by halving; past the last
    # place the ring starts again.
    places_lit, n = bigint_array(bounds), len(bounds)
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    before_key = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when(F.get(places_lit, at + step - 1) < F.col("key"), at + step).otherwise(at),
    )
    keyed = ranked.withColumn("arc", before_key % n)

    # One row per arc: how many rows it has, and the rank of the first.  The first arc holds
    # the keys before the first place and those after the last one.
    counts = keyed.groupBy("arc").agg(
        F.count("*").alias("rows"), F.count_if(F.col("key") <= bounds[0]).alias("head")
    )
    loads, head = {}, 0
    for row in counts.collect():  # a row for each place at most
        loads[row["arc"]] = row["rows"]
        head += row["head"]
    first, before = {}, 0
    for arc in range(len(bounds)):
        first[arc] = before
        before += head if arc == 0 else loads.get(arc, 0)
    pieces = walk(list(enumerate(shard for _, shard in places)), loads, shards)
    total = sum(loads.values())
    # Ranks of the first arc run on from its tail at the end of the sort to its head.
    tail = loads.get(0, 0) - head
    table = spark.createDataFrame(
        [(p.arc, p.first_rank, p.first_rank + p.rows, p.shard, p.slot - p.first_rank) for p in pieces],
        "arc int, low bigint, high bigint, shard int, shift bigint",
    )
    firsts = bigint_array([first[arc] for arc in range(len(bounds))])
    within = F.when(
        F.col("arc") == 0,
        F.when(F.col("key") > bounds[-1], F.col("rank") - (total - tail)).otherwise(F.col("rank") + tail),
    ).otherwise(F.col("rank") - F.get(firsts, F.col("arc")))
    inside = keyed.withColumn("within", within)
    owner = F.get(bigint_array([shard for _, shard in places]), F.col("arc"))
    return (
        inside.join(F.broadcast(table), "arc")  # bounded by the ring, not by the documents
        .where((F.col("within") >= F.col("low")) & (F.col("within") < F.col("high")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("within") + F.col("shift")).alias("slot"),
            "arc",
            (F.col("shard") != owner).alias("moved"),
        )
    )


def shards_of_documents(docs: DataFrame) -> DataFrame:
    """The rows of the query: 40 shards under the law of equal row counts."""
    return sharded(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "moved",
    )
