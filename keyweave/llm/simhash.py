"""SimHash near-duplicates: segment popcounts, a grid join, exact verification.

A fingerprint of 64 bits is cut into 16 segments of four bits.  The bit counts of the segments
are a point in a grid of 16 dimensions.  One differing bit moves the point by one step at
most, so the Manhattan distance of two points is a lower bound of the number of differing
bits: fingerprints within two bits are points within two steps.

Points within two steps have a grid cell within one step of both.  So each distinct
fingerprint is put into its own cell and the cells one step away (33 at most), and those that
meet in a cell are verified exactly by the bits of their XOR.

Copies share a fingerprint and are one entry of the grid.  A cell with very many different
fingerprints is not paired off: its fingerprints are dealt anew under the 65 bit strings
within one bit of them.  Two fingerprints within two bits share one of these, and those that
share one (65 at most) are all within two bits of each other, so a star links them.  No link is lost,
and the work grows with the number of fingerprints, not of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm import similar
from keyweave.llm.columns import travels_with_the_job
from keyweave.llm.components import connected
from keyweave.llm.similar import similar_links, text_key
from keyweave.operators.joins import inner_join_unique, left_join_unique
from keyweave.session import materialize

travels_with_the_job(__name__)

SEED = 42
SHINGLE_WORDS = 3
MOST_BITS = 2
SEGMENTS, SEGMENT_BITS = 16, 4
#: Cells with more fingerprints than this are dealt anew instead of paired off.
CROWDED = 32
#: Cells up to so many are broadcast to pick their entries, more are shuffled.
MOST_BROADCAST = 1_000_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a whole text as an unsigned number; 0 if it has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over_half = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over_half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """The columns ``keep`` of every row, and ``fp``: its fingerprint as a signed number."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(0)], dtype=np.uint64)
            columns = [*batch.columns[1:], pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fp"])

    rows = docs.select(F.col(text), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(of_batches, f"{kept}, fp bigint")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 16 segments, four bits each, in one number."""

    one_each = F.lit(0x1111111111111111)
    bits = [F.shiftrightunsigned(fp, bit).bitwiseAND(one_each) for bit in range(SEGMENT_BITS)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def grid_cells(fp: Column) -> Column:
    """The cell of a fingerprint and the cells one step away, inside the grid."""
    point = segment_counts(fp)

    def steps(point: Column) -> Column:
        near = [point]
        for s in range(SEGMENTS):
            count = F.shiftrightunsigned(point, SEGMENT_BITS * s).bitwiseAND(F.lit(15))
            unit = F.lit(1 << SEGMENT_BITS * s).cast("bigint")
            near.append(F.when(count < SEGMENT_BITS, point + unit))
            near.append(F.when(count > 0, point - unit))
        return F.array_compact(F.array(*near))

    return F.transform(F.array(point), steps)[0]


def _verified(pairs: DataFrame) -> DataFrame:
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return pairs.where((F.col("a") != F.col("b")) & (differing <= MOST_BITS))


def _those_in(cells: DataFrame, some: DataFrame) -> DataFrame:
    """The entries of the given cells, which are few and counted before they are broadcast."""
    keys = some.select("cell")
    return cells.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, "cell", "left_semi")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of ``fp`` within two bits.

    Every pair in a cell that is not crowded is a link if verified; a crowded cell gives stars.
    """
    # A fingerprint has eight bytes and 33 entries, so few and small files would give few and large tasks.
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    cells = dealt.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    filled = materialize(
        cells.groupBy("cell")
        .agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
        .where("n > 1"),
        "cells",
    )
    twos = _verified(filled.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")))

    several = _those_in(cells, filled.where(f"n > 2 and n <= {CROWDED}"))
    listed = several.groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # CROWDED at most
    placed = listed.select("fps", F.posexplode("fps").alias("at", "a"))
    later = placed.select("a", F.explode(F.slice("fps", F.col("at") + 2, CROWDED)).alias("b"))

    crowd = _those_in(cells, filled.where(f"n > {CROWDED}"))
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)))
    stars = (
        crowd.select("fp")
        .distinct()
        .select("fp", F.explode(flips).alias("near"))
        .groupBy("near")
        .agg(F.collect_list("fp").alias("fps"))  # 65 at most
        .where(F.size("fps") > 1)
        .select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    )
    return twos.union(_verified(later)).union(_verified(stars))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, itself included; NULL if no row of
    the component has a doc_id.  NULL, empty and blank texts have fingerprint zero and
    are linked like any other.  Repeated rows are repeated.
    """
    rows = fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"])
    stored = materialize(rows, "fingerprints", similar.BATCH_BYTES)
    return _with_component(stored, F.min("doc_id"), fingerprint_links).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("chosen").alias("component_id"),
    )


def _with_component(
    stored: DataFrame, choice: Column, links_of: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``stored`` (fp and more) with ``chosen``: the least choice among all rows of a component."""
    distinct = materialize(stored.groupBy("fp").agg(choice.alias("choice")), "distinct")
    linked = connected(links_of(distinct.select("fp")))
    members = inner_join_unique(distinct, linked.withColumnRenamed("node", "fp"), ["fp"])
    members = materialize(members, "members")
    chosen = members.groupBy("component").agg(F.min("choice").alias("chosen"))
    of_members = members.select("fp", "component").join(chosen, "component").select("fp", "chosen")
    labels = left_join_unique(distinct, of_members, ["fp"], ["fp"]).select(
        "fp", F.coalesce("chosen", "choice").alias("chosen")
    )
    return left_join_unique(stored, labels, ["fp"], ["fp"])


def near_prints(texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Pairs (a, b) of texts by ``fp``, their ``text_key``, that a star or a link of fingerprints joins.

    Texts of one fingerprint are paired with the first of them, and the first ones as ``fingerprint_links`` gives them.
    """
    prints = fingerprints(texts.withColumnRenamed("fp", "node"), ["node"], words=words)
    prints = materialize(prints.dropDuplicates(["node"]), "prints", similar.BATCH_BYTES)
    firsts = materialize(prints.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    pairs = fingerprint_links(firsts.select("fp"))
    for end in ("a", "b"):
        of_end = firsts.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}"))
        pairs = inner_join_unique(pairs, of_end, [end])
    same = inner_join_unique(prints, firsts, ["fp"]).where("node <> first")
    return same.select(F.col("node").alias("a"), F.col("first").alias("b")).union(pairs.select("first_a", "first_b"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays.

    Here the rule is that of the stages, not that of the query: texts whose five-word shingles have a Jaccard similarity
    of 0.8 or more are linked.  Texts whose fingerprints over these shingles are within two bits come first
    (``near_prints``) and are compared exactly; ``similar_links`` adds all other pairs.  The row with the smallest
    doc_id stays; rows without doc_id come last, and among rows with one doc_id a hash of the whole
    row decides.  The columns are those of ``docs``.
    """
    names = docs.columns
    row = F.xxhash64(*(F.to_json(f"`{n}`") if "map<" in t else F.col(f"`{n}`") for n, t in docs.dtypes))
    whole = docs.select(F.struct(*(f"`{n}`" for n in names)).alias("_row"), row.alias("_hash"))
    marked = whole.select(
        "_row",
        F.struct(
            F.col("_row.doc_id").isNull().alias("absent"),
            F.coalesce(F.col("_row.doc_id").cast("bigint"), F.lit(0)).alias("doc_id"),
            F.col("_hash").alias("hash"),
        ).alias("_key"),
    )
    texts = marked.select(F.col("_row.text").alias("text"), text_key(F.col("_row.text")).alias("fp"))
    stored = materialize(
        marked.select(
            F.col("_key.absent").alias("absent"),
            F.col("_key.doc_id").alias("id"),
            F.col("_key.hash").alias("hash"),
            text_key(F.col("_row.text")).alias("fp"),
        ),
        "keys",
    )
    key = F.struct("absent", "id", "hash")
    winners = (
        _with_component(
            stored.withColumn("key", key),
            F.min("key"),
            lambda _: similar_links(texts, near_prints(texts, similar.SHINGLE_WORDS)),
        )
        .where(F.col("key") == F.col("chosen"))
        .groupBy("absent", "id", "hash")
        .agg(F.count("*").alias("copies"))
    )
    winners = materialize(winners, "winners")

    def rows_of(keys: DataFrame) -> DataFrame:
        met = (F.col("_key.absent") == F.col("absent")) & (F.col("_key.doc_id") == F.col("id"))
        return marked.join(keys, met & (F.col("_key.hash") == F.col("hash")), "left_semi").select("_row.*")

    result = rows_of(winners.where("copies = 1"))
    repeated = winners.where("copies > 1")
    if not repeated.isEmpty():  # whole rows that repeat: any one of them stays
        twins = marked.join(
            repeated,
            (F.col("_key.absent") == F.col("absent"))
            & (F.col("_key.doc_id") == F.col("id"))
            & (F.col("_key.hash") == F.col("hash")),
        )
        once = twins.groupBy("absent", "id", "hash").agg(F.first("_row").alias("_row"))
        result = result.union(once.select("_row.*"))
    return result
