"""Near copies by similarity: a prefix filter over five-word shingles, exact verification.

Two texts are near copies if their sets of shingles have a Jaccard similarity of 0.8 or more.  All
shingles have one order.  A text of n shingles is put into the cells of its first
n - ceil(0.8 n) + 2; two near copies always share two of these (or the only one), whatever the order is, so no pair
is lost.  What follows the place of a shared shingle bounds the overlap: at the first two that they share, this
bound is short of the overlap by one at most.  So a cell gives only pairs that can still reach 0.8 from there, and only
pairs that two cells give go on, or one cell if both texts are in cells that are too full to give all pairs.

Of the texts of such pairs each gets a fingerprint of 4,096 bits: a bit tells whether an odd number of its shingles
have that hash.  A shingle that only one of two texts has flips one bit, so the bits that differ are a lower bound of
the number of such shingles, which is a ninth of both sets at most where the similarity is 0.8.  Pairs beyond it go.
The whole texts of the others are brought together and compared exactly.

The order only sets the cost: shingles that are frequent in a sample of documents come last, so
that a passage many documents share fills no cell.

A cell with very many texts is not paired off at once.  Its texts are verified against the one
that has the fewest rarer shingles; after that, texts that are not in the cell's largest component
are paired with all that are in other components.  Pairs within one component link nothing new.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import ASCII_SPACE, travels_with_the_job
from keyweave.llm.components import connected
from keyweave.operators.joins import inner_join_unique, left_join_unique
from keyweave.session import materialize, release, small_batches

travels_with_the_job(__name__)

SHINGLE_WORDS = 5
#: Cells with more texts than this are not paired off at once.
CROWDED = 32
#: Numbers of 64 bits in the fingerprint that bounds the difference of two texts.
PARITY_WORDS = 64
#: Bytes of a batch of texts or cells for a Python worker, about.
BATCH_BYTES = 2 << 20
#: Documents that the order of the shingles is counted on, about.
ORDER_DOCS = 10_000
#: A shingle of so many sampled documents is frequent.
FREQUENT = 3
#: The table of cells with several texts has 2 to this power bits.
TABLE_BITS = 27
_ROW_BITS = 15
#: Tables of keys up to so many rows are broadcast, more are shuffled.
MOST_BROADCAST = 1_000_000


def text_key(text: Column) -> Column:
    """A number per different text; 0 for all that have no word."""
    blank = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE)) == ""
    return F.when(blank, F.lit(0).cast("bigint")).otherwise(F.xxhash64(text))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The different hashes of the shingles of a whole text, in order; none if it has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules
    if len(found) < words:
        held = [b" ".join(found)] if found else []
    else:
        held = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, held, repeat(0)), dtype=np.uint64).view(np.int64))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample by hash, in order, and the number of its documents that have them."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()))], names=["cell"])

    one_in = max(1, docs.count() // ORDER_DOCS)
    some = docs.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0).dropDuplicates(["fp"]).select("text")
    counted = some.mapInArrow(of_batches, "cell bigint").groupBy("cell").count().where(F.col("count") >= FREQUENT)
    with small_batches(docs.sparkSession, BATCH_BYTES):
        found = counted.toArrow()
    cells, counts = found.column("cell").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(cells)
    return cells[order], counts[order]


def _cells(docs: DataFrame) -> DataFrame:
    """(cell, fp, n, at) for the first shingles of every text: the number of all of them, and the place."""
    frequent, counts = _frequent(docs)

    def first_ones(held: np.ndarray) -> np.ndarray:
        ranks = np.zeros(len(held), dtype=np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, held), len(frequent) - 1)
            ranks = np.where(frequent[at] == held, counts[at], 0)
        least = (4 * len(held) + 4) // 5
        return held[np.lexsort((held, ranks))[: len(held) - least + 2]]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, fp in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held = shingles(text.as_py())
                if len(held):
                    cells = first_ones(held)
                    n = len(cells)
                    sizes, places = np.full(n, len(held), np.int32), np.arange(n, dtype=np.int32)
                    columns = [pa.array(c) for c in (cells, np.full(n, fp, np.int64), sizes, places)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "fp", "n", "at"])

    return docs.select("text", "fp").mapInArrow(of_batches, "cell bigint, fp bigint, n int, at int")


def _in_shared_cells(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``cells`` whose cell is in ``shared``.

    Most cells have one text.  A table of bits by hash, of one size whatever there is, drops nearly all of them before
    the rest is joined.
    """
    spark, width = cells.sparkSession, 1 << _ROW_BITS - 3
    at = F.col("cell").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    rows = (
        shared.select(F.shiftright(at, _ROW_BITS).alias("row"), at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("bit"))
        .groupBy("row")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # the table, no more
    )
    table = np.zeros((1 << TABLE_BITS - _ROW_BITS, width), np.uint8)
    for row in rows:
        table[row["row"]] = np.frombuffer(row["bits"], np.uint8)
    held = spark.sparkContext.broadcast(table.reshape(-1))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << TABLE_BITS) - 1)
            yield batch.filter(pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    some = cells.select("cell", "fp", "n", "at").mapInArrow(of_batches, "cell bigint, fp bigint, n int, at int")
    return some.join(shared, "cell", "left_semi")


def _parities(docs: DataFrame) -> DataFrame:
    """(fp, n, bits): the number of shingles of each text, and the parity of their number by hash."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = [], []
            for text in batch.column(0):
                held = shingles(text.as_py())
                counts = np.bincount(held & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS)
                sizes.append(len(held))
                bits.append(np.packbits(counts & 1, bitorder="little").view(np.int64).tolist())
            columns = [batch.column(1), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["fp", "n", "bits"])

    return docs.select("text", "fp").mapInArrow(of_batches, "fp bigint, n int, bits array<bigint>")


def _alike(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, text_a, text_b) with a similarity of 0.8 or more."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if last is None or last[0] != a:
                    last = a, shingles(text_a.as_py())
                held = shingles(text_b.as_py())
                shared = len(np.intersect1d(last[1], held, assume_unique=True))
                keep.append(9 * shared >= 4 * (len(last[1]) + len(held)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(of_batches, "a bigint, b bigint")


def _those_in(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    keys = keys.select(key)
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, key, how)


def _can_reach(a: str, b: str) -> Column:
    """Whether two texts can have a similarity of 0.8 if this is the first or second shingle that they share."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return 9 * (left + 1) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _often_met(pairs: DataFrame, in_crowds: DataFrame | None) -> DataFrame:
    """Of pairs (a, b, n), one row per cell, those that enough cells give."""
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("cells"), F.min("n").alias("n"))
    enough = F.col("cells") >= F.least(F.lit(2), F.col("n"))
    if in_crowds is None:
        return met.where(enough).select("a", "b")
    once = met.where(~enough).select("a", "b")
    for end in ("a", "b"):
        once = _those_in(once, in_crowds.withColumnRenamed("fp", end), end)
    return met.where(enough).select("a", "b").union(once.select("a", "b"))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with a similarity of 0.8 or more, by their whole sets; a written table."""
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def rows_of(some: DataFrame) -> DataFrame:
        both = materialize(some.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "ends")
        return _those_in(docs, both, "fp")

    def joined(rows: DataFrame, of_text: DataFrame, *names: str) -> DataFrame:
        # The texts are dealt by fp already, and stay where they are: the pairs come to them.
        for end in ("a", "b"):
            named = of_text.select(F.col("fp").alias(end), *(F.col(n).alias(f"{n}_{end}") for n in names))
            rows = rows.join(named, end)
        return rows

    once = materialize(pairs.where("a <> b").select(*ends).distinct(), "pairs")
    parities = materialize(_parities(rows_of(once)).dropDuplicates(["fp"]), "parities", BATCH_BYTES)
    flips = F.zip_with("bits_a", "bits_b", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differing = F.aggregate(flips, F.lit(0), lambda total, n: total + n)
    near = joined(once, parities, "n", "bits").where(9 * differing <= F.col("n_a") + F.col("n_b")).select("a", "b")
    near = materialize(near, "near")
    texts = rows_of(near).dropDuplicates(["fp"])
    found = materialize(_alike(joined(near, texts, "text")), "similar", BATCH_BYTES)
    release(once, parities, near)
    return found


def _across(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one group (fp, group) already."""
    for end in ("a", "b"):
        of_end = group.select(F.col("fp").alias(end), F.col("group").alias(f"group_{end}"))
        pairs = left_join_unique(pairs, of_end, [end], [end])
    return pairs.where(F.coalesce(F.col("group_a") != F.col("group_b"), F.lit(True))).select("a", "b")


def similar_links(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of ``fp`` with a similarity of 0.8.

    ``docs`` has text and fp, its ``text_key``; rows may repeat.  ``candidates`` are pairs (a, b) to verify first; pairs
    that these link, directly or not, are not compared again.
    """
    known = _verified(candidates, docs)
    linked = connected(known).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    linked = materialize(linked, "linked")
    cells = materialize(_cells(docs), "cells", BATCH_BYTES)
    shared = cells.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    shared = materialize(shared.select("cell"), "shared")
    entries = materialize(_in_shared_cells(cells, shared).distinct(), "entries", BATCH_BYTES)
    release(cells, shared)

    crowded = materialize(entries.groupBy("cell").count().where(F.col("count") > CROWDED), "crowded")
    several = _those_in(entries, crowded, "cell", "left_anti")
    text = F.struct("n", "fp", "at")
    listed = several.groupBy("cell").agg(F.sort_array(F.collect_list(text)).alias("held"))  # CROWDED at most
    placed = listed.select("held", F.posexplode("held").alias("nr", "a"))
    pairs = placed.select("a", F.explode(F.slice("held", F.col("nr") + 2, CROWDED)).alias("b"))
    n = F.least("a.n", "b.n").alias("n")
    ends = (F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))
    pairs = pairs.where(_can_reach("a", "b")).select(*ends, n)
    if crowded.isEmpty():
        return known.union(_verified(_across(_often_met(pairs, None), linked), docs))

    crowd = materialize(_those_in(entries, crowded, "cell"), "crowd")
    in_crowds = materialize(crowd.select("fp").distinct(), "in-crowds")
    pairs = _often_met(pairs, in_crowds)
    chosen = crowd.groupBy("cell").agg(F.min(F.struct("at", "fp", "n")).alias("b"))
    stars = inner_join_unique(crowd.select("cell", text.alias("a")), chosen, ["cell"]).where(_can_reach("a", "b"))
    stars = stars.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    first = known.union(_verified(_across(pairs.union(stars), linked), docs))
    group = connected(first).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    grouped = materialize(
        left_join_unique(crowd, group, ["fp"], ["fp"]).select(
            "cell", "fp", text.alias("a"), F.coalesce("group", "fp").alias("group")
        ),
        "grouped",
    )
    sizes = grouped.groupBy("cell", "group").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cell").agg(F.max(F.struct("size", "group")).alias("main"))
    rest = inner_join_unique(grouped, main, ["cell"]).where(F.col("group") != F.col("main.group"))
    mates = grouped.select("cell", F.col("a").alias("b"), F.col("group").alias("other"))
    apart = rest.join(mates, "cell").where((F.col("group") != F.col("other")) & _can_reach("a", "b"))
    return first.union(_verified(apart.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")), docs))
