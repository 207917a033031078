"""Source divergence audit: how far the words of each source are from those of the others of its language.

Terms are counted by iceberg prefix refinement.  Each level looks at the byte prefixes of twice the length: in how
many documents of a language a prefix occurs.  A prefix in too few documents is discarded, because no term
that begins with it can be in more; the next level extends the others only.  A term that is shorter than the
level's prefixes is complete there and gets its counts per source.  The levels end when no prefix is left.

* What a level hands to the next one is a table of bits, one per hash of (language, prefix).  Its size is a
  parameter, whatever the corpus holds.  A prefix that shares a bit with a kept one is counted once more, and
  the exact count discards it then, so collisions cost time, not results.
* A task adds up its counts and hands them on when it holds ``most_held`` of them, so no text, language or source
  is ever gathered, and a source with a third of all documents is no more than a column.
* Terms in enough documents are dealt into blocks of bounded size (terms times sources of the language).  A block is a matrix of
  counts; its shares of the sums over pairs of sources and its ten best terms of each source are added up.

All arithmetic is exact, in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyweave.llm.columns import travels_with_the_job
from keyweave.operators.joins import left_join_unique
from keyweave.session import materialize

travels_with_the_job(__name__)

_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
#: For each byte: letters, A-Z in lower case, and bytes of characters beyond ASCII stay; all others part terms.
LETTERS = bytes(
    b if b >= 0x80 or b in _LOWER else b + 32 if b in _UPPER else 0x20 for b in range(256)
)
#: Bytes from which words are long.
LONG = 12
#: Seed and bits per row of the table of bits, as Spark's xxhash64 and bitmap_construct_agg have them.
_SEED, _ROW_BITS = 42, 15
_COUNTS = "lang string, source string, item binary, complete boolean, docs bigint, n bigint"
_SHARES = "lang string, source string, part string, item string, value bigint"
#: Counts above this are multiplied as Python's whole numbers.
_MOST_FAST = 9_000_000_000


@dataclass(frozen=True)
class Settings:
    least_documents: int = 10
    #: Bytes of the prefixes of the first level; each level doubles them.  Shorter terms, most words, are counted at once.
    first_bytes: int = 12
    #: The table of kept prefixes has 2 to this power bits.
    table_bits: int = 26
    #: Counts that a task holds before it hands them on.
    most_held: int = 700_000
    #: Cells of the matrix of a block.
    block_cells: int = 1 << 19
    top_terms: int = 10
    scale: int = 1_000_000_000


def _counted(docs: DataFrame, size: int, kept: object, settings: Settings) -> DataFrame:
    """Counts of the items of a level: complete terms per source, prefixes of ``size`` bytes per language.

    ``kept`` is the broadcast table of bits of the level before, or None on the first level.
    """
    before = size // 2 if kept else 0
    mask = (1 << settings.table_bits) - 1
    most = settings.most_held
    # Long words are rare: looked for, they are found faster than by parting all words.
    long_words = re.compile(rb"(?<![a-z\x80-\xff])[a-z\x80-\xff]{%d,}" % before) if before >= LONG else None

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = kept.value if kept else b""
        # Per language: the terms whose prefix was kept, and those that are done or discarded.
        seen: dict[str, tuple[set, set]] = {}
        # Per language and source, or language and None for prefixes: documents, and occurrences beyond one in each of them.
        held: dict[tuple[str, str | None], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def goes_on(seed: int, term: bytes) -> bool:
            at = xxhash.xxh64_intdigest(term[:before], seed) & mask
            return len(term) >= before and bits[at >> 3] >> (at & 7) & 1

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (docs_of, more_of) in held.items():
                n, keys = len(docs_of), list(docs_of)
                in_docs = np.fromiter(docs_of.values(), np.int64, n)
                more = np.fromiter(map(more_of.get, keys, repeat(0)), np.int64, n)
                columns = [
                    pa.repeat(pa.scalar(lang, pa.string()), n),
                    pa.repeat(pa.scalar(source, pa.string()), n),
                    pa.array(keys, pa.binary()),
                    pa.repeat(pa.scalar(source is not None), n),
                    pa.array(in_docs),
                    pa.array(in_docs + more),
                ]
                whole = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "complete", "docs", "n"])
                yield from (whole.slice(first, 50_000) for first in range(0, n, 50_000))
            held.clear()

        n_held = 0
        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for text, lang, source in zip(batch.column(0), langs, sources, strict=True):
                letters = text.as_py().translate(LETTERS)
                counts = Counter(long_words.findall(letters) if long_words else letters.split())
                terms = counts.keys()
                if kept:
                    known, dropped = seen.setdefault(lang, (set(), set()))
                    terms = terms - dropped
                    new = terms - known
                    if new:
                        seed = xxhash.xxh64_intdigest(lang.encode(), _SEED)
                        known.update(term for term in new if goes_on(seed, term))
                        new -= known
                        dropped |= new
                        terms -= new
                    if len(known) + len(dropped) > most:
                        seen.clear()
                complete = [term for term in terms if len(term) < size]
                prefixes = {term[:size] for term in terms if len(term) >= size}
                docs_of, more_of = held[lang, source]
                of_lang, _ = held[lang, None]
                before_it = len(docs_of) + len(of_lang)
                docs_of.update(complete)
                of_lang.update(prefixes)
                for term in complete:
                    if counts[term] > 1:
                        more_of[term] += counts[term] - 1
                n_held += len(docs_of) + len(of_lang) - before_it
                if n_held > most:
                    yield from handed_on()
                    n_held = 0
        yield from handed_on()

    return docs.select("text", "lang", "source").mapInArrow(of_batches, _COUNTS)


def _table_of_bits(prefixes: DataFrame, settings: Settings) -> bytes | None:
    """A bit per hash of (lang, item); None without any row.  What comes to the driver is the table, no more."""
    at = F.xxhash64("lang", "item").bitwiseAND(F.lit((1 << settings.table_bits) - 1))
    rows = (
        prefixes.select(
            F.shiftright(at, _ROW_BITS).alias("row"), at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("bit")
        )
        .groupBy("row")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    if not rows:
        return None
    width = 1 << _ROW_BITS - 3
    table = bytearray(max(width, 1 << settings.table_bits - 3))
    for row in rows:
        table[row["row"] * width : (row["row"] + 1) * width] = row["bits"]
    return bytes(table)


def kept_terms(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(lang, item, docs, sources): the terms that are in enough documents of a language.

    ``sources`` lists (source, n), the occurrences in each source that has the term.  A row of ``docs`` is a document;
    NULL text, lang and source are empty texts.
    """
    settings = settings or Settings()
    context = docs.sparkSession.sparkContext
    clean = docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
    )
    size, kept, complete = settings.first_bytes, None, []
    while True:
        counts = _counted(clean, size, kept, settings)
        added = counts.groupBy("lang", "source", "item", "complete").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("n")
        )
        level = materialize(added, f"prefixes-{size}")
        complete.append(level.where("complete"))
        if kept:
            kept.unpersist()
        bits = _table_of_bits(level.where(~F.col("complete") & (F.col("docs") >= settings.least_documents)), settings)
        if bits is None:
            break
        kept, size = context.broadcast(bits), 2 * size
    rows = complete[0]
    for more in complete[1:]:
        rows = rows.union(more)
    return (
        rows.groupBy("lang", "item")
        .agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
        .where(F.col("docs") >= settings.least_documents)
    )


def _probabilities(counts: np.ndarray, total: np.ndarray, terms: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 2) / (total + 2 * terms)), exact."""
    if counts.size and int(counts.max()) > _MOST_FAST:
        counts = counts.astype(object)
    return (1 + scale * (counts + 2) // (total + 2 * terms)).astype(np.int64)


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shares_of_block(terms: pa.Table, groups: pa.Table, settings: Settings) -> pa.Table:
    """What a block of terms adds to each pair of sources, and its best terms of each source."""
    lang = groups.column("lang")[0].as_py()
    sources = groups.column("source").combine_chunks()
    total = groups.column("total").to_numpy()
    n_terms, lang_total = groups.column("terms")[0].as_py(), groups.column("lang_total")[0].as_py()
    n_sources = len(sources)
    terms = terms.take(pc.sort_indices(terms.column("item")))  # by bytes
    items = terms.column("item").combine_chunks()
    listed = terms.column("sources").combine_chunks()
    flat = listed.flatten()
    counts = np.zeros((len(items), n_sources), np.int64)
    places = pc.index_in(flat.field("source"), value_set=sources).to_numpy(zero_copy_only=False)
    counts[pc.list_parent_indices(listed).to_numpy(), places] = flat.field("n").to_numpy()

    p = _probabilities(counts, total, n_terms, settings.scale) if n_terms else counts
    sums = np.zeros((n_sources, n_sources), np.int64)
    for a in range(n_sources if len(items) else 0):
        sums[a, a + 1 :] = _differences(p[:, a : a + 1], p[:, a + 1 :]).sum(axis=0)
    sums += sums.T
    one, other = np.nonzero(~np.eye(n_sources, dtype=bool))
    made = [(one, "pair", sources.take(pa.array(other)), sums[one, other])]

    q = _probabilities(counts.sum(axis=1), lang_total, n_terms, settings.scale) if len(items) else np.zeros(0)
    for a in range(n_sources if len(items) else 0):
        above = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > q))
        values = _differences(p[above, a], q[above])
        best = np.argsort(-values, kind="stable")[: settings.top_terms]
        names = items.take(pa.array(above[best])).cast(pa.string())
        made.append((np.full(len(best), a), "term", names, values[best]))
    parts = [
        pa.table(
            {
                "lang": pa.array([lang] * len(values), pa.string()),
                "source": sources.take(pa.array(at)),
                "part": pa.array([part] * len(values), pa.string()),
                "item": names,
                "value": pa.array(values, pa.int64()),
            }
        )
        for at, part, names, values in made
    ]
    return pa.concat_tables(parts)


def source_divergence(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that occurs.

    * ``pair``: ``item`` is each other source of the language, ``value`` the sum of the differences of all kept terms (0 without
      any), all ranks.
    * ``term``: ``item`` is a kept term that the source has, more often than its language, ``value`` its
      difference, the first ``top_terms`` ranks.

    The difference is floor((p - q)^2 / (p + q)), p = 1 + floor(scale * (count + 2) / (N + 2 V)), N the occurrences of
    all V kept terms.  Ranks count from 1 by value descending, then item by its bytes.  NULL text, lang and source are
    empty texts; a source without terms has its pairs, a source alone in its language has none.  Repeated rows
    are documents of their own; other columns are not looked at; an empty table gives an empty one.
    """
    settings = settings or Settings()
    terms = materialize(kept_terms(docs, settings), "terms")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    found = docs.select(*named).distinct()
    in_source = (
        terms.select("lang", F.explode("sources").alias("s"))
        .groupBy("lang", "s.source")
        .agg(F.sum("s.n").alias("total"))
    )
    in_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = left_join_unique(found, in_source, ["lang", "source"], ["lang", "source"])
    groups = materialize(left_join_unique(groups, in_lang, ["lang"], ["lang"]).na.fill(0, ["total", "terms"]), "sources")
    of_lang = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.count("*").alias("n_sources"), F.max("terms").alias("of_terms")
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.col("of_terms") * F.col("n_sources") / settings.block_cells)).cast("int")
    of_lang = materialize(of_lang.select("lang", "lang_total", blocks.alias("blocks")), "languages")
    in_blocks = (
        left_join_unique(groups, of_lang, ["lang"], ["lang"])
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .drop("blocks")
    )
    dealt = (
        left_join_unique(terms, of_lang.drop("lang_total"), ["lang"], ["lang", "item"])
        .withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
        .select("lang", "block", "item", "sources")
    )

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        return _shares_of_block(left, right, settings)

    shares = dealt.groupBy("lang", "block").cogroup(in_blocks.groupBy("lang", "block")).applyInArrow(of_block, _SHARES)
    added = shares.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return added.withColumn("rank", F.row_number().over(order)).where(
        (F.col("part") == "pair") | (F.col("rank") <= settings.top_terms)
    )
