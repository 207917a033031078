"""I-Match fingerprints: the terms of a document that are neither frequent nor rare, hashed by lexicon subsets.

* The lexicon holds the terms whose inverse document frequency lies in a band.  A term in the band is in a share
  of ``exp(-highest_idf)`` of all documents at least, so the lexicon has at most ``exp(highest_idf)`` times as many
  terms as a document has on average, however many documents there are.
* The MD5 of a term draws the subsets of the lexicon that it belongs to.  There are ``levels`` of 16 subsets each; those of
  the first level share out the whole lexicon, those of each further level hold a quarter of the terms
  of the one before.  Short texts differ in the large subsets, long ones still agree in the small ones.
* The distinct terms of a document in one subset, sorted, give one hash.  The fingerprint lists the hashes of all subsets
  that have a term of the document, ten hex digits each: two for the subset, eight for the hash.  A document without
  any term of the lexicon has the MD5 of its text instead, under numbers that no subset has.
* The likeness of two fingerprints is the share of equal entries among the subsets in either, per level, and of
  these shares the mean.

All of it is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import let
from keyweave.operators.sequence import numbered
from keyweave.session import materialize

BETWEEN_TERMS = r"[^\p{L}\p{M}\p{N}]+"
SUBSETS = 16
#: Hex digits of an entry: its subset and its hash.
SUBSET_DIGITS, HASH_DIGITS = 2, 8
_ENTRY = SUBSET_DIGITS + HASH_DIGITS
#: Subsets of the entries of a text without terms of the lexicon: its whole MD5.
NO_TERMS = ("fc", "fd", "fe", "ff")


@dataclass(frozen=True)
class Settings:
    lowest_idf: float = 3.0
    highest_idf: float = 6.2
    levels: int = 5
    #: Lexicons up to so many terms are broadcast, larger ones shuffled.
    most_broadcast: int = 1_000_000


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: runs of letters, marks and digits in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BETWEEN_TERMS)), "")


def _subsets(term: Column, levels: int) -> Column:
    """The subsets of a term, as two hex digits: four digits of its MD5 decide on each level."""
    digest = F.md5(term.cast("binary"))

    def of_level(level: int) -> Column:
        drawn = F.conv(F.substring(digest, 4 * level + 1, 4), 16, 10).cast("int") % (SUBSETS << 2 * level)
        return F.when(drawn < SUBSETS, F.lpad(F.lower(F.hex(drawn + SUBSETS * level)), SUBSET_DIGITS, "0"))

    return F.array_compact(F.array(*(of_level(level) for level in range(levels))))


def lexicon(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(term, subsets) for the terms in the band; ``docs`` has text, every row is a document."""
    settings = settings or Settings()
    n_docs = docs.count()
    found = docs.select(F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("term"))
    idf = F.log(F.lit(float(n_docs)) / F.col("count"))
    return (
        found.groupBy("term")
        .count()
        .where((idf >= settings.lowest_idf) & (idf <= settings.highest_idf))
        .select("term", _subsets(F.col("term"), settings.levels).alias("subsets"))
    )


def _entries(held: Column) -> Column:
    """One entry per subset from (subset, term) of a text, in order of the subsets."""

    def lines(held: Column) -> Column:
        begins = F.transform(
            held,
            lambda x, i: F.concat(
                F.when((i > 0) & (F.get(held, i - 1)["subset"] == x["subset"]), " ").otherwise(
                    F.concat(F.lit("\n"), x["subset"], F.lit(" "))
                ),
                x["term"],
            ),
        )
        return F.split(F.substr(F.array_join(begins, ""), F.lit(2)), "\n")

    def entry(line: Column) -> Column:
        terms = F.substr(line, F.lit(SUBSET_DIGITS + 2))
        return F.concat(F.left(line, F.lit(SUBSET_DIGITS)), F.left(F.md5(terms.cast("binary")), F.lit(HASH_DIGITS)))

    return F.array_join(F.transform(let(F.array_sort(held), lines), entry), "")


def _without_terms(digest: Column) -> Column:
    return F.concat(
        *(
            F.concat(F.lit(subset), F.substring(digest, HASH_DIGITS * i + 1, HASH_DIGITS))
            for i, subset in enumerate(NO_TERMS)
        )
    )


def fingerprinted(
    texts: DataFrame, known: DataFrame, key: list[str], keep: list[str], settings: Settings | None = None
) -> DataFrame:
    """``key``, ``keep`` and fingerprint of each row; ``texts`` has text, and ``key`` tells its rows apart.

    ``known`` is the lexicon.  A table dealt by columns of ``key`` is not shuffled again while the lexicon is broadcast.
    """
    settings = settings or Settings()
    # Every text has the empty term, and the lexicon has it without a subset: it keeps the text in the
    # join and holds what is needed once.
    nothing = known.sparkSession.range(1).select(F.lit("").alias("term"), F.array().cast("array<string>").alias("subsets"))
    known = known.union(nothing)
    if known.count() <= settings.most_broadcast:
        known = F.broadcast(known)
    once = F.struct(*keep, F.md5(F.col("text").cast("binary")).alias("digest"))
    terms = texts.select(
        *key, once.alias("once"), F.explode(F.concat(F.array(F.lit("")), terms_of(F.col("text")))).alias("term")
    )
    found = (
        terms.withColumn("once", F.when(F.col("term") == "", F.col("once")))
        .join(known, "term")
        .select(*key, "once", "term", F.explode_outer("subsets").alias("subset"))
        .groupBy(*key)
        .agg(
            F.first("once", ignorenulls=True).alias("once"),
            F.collect_list(F.when(F.col("subset").isNotNull(), F.struct("subset", "term"))).alias("held"),
        )
    )
    own = F.when(F.size("held") > 0, _entries(F.col("held"))).otherwise(_without_terms(F.col("once.digest")))
    return found.select(*key, *(f"once.{name}" for name in keep), own.alias("fingerprint"))


def likeness(one: Column, other: Column) -> Column:
    """The mean share of equal entries per level: 1 for equal fingerprints, 0 without an equal entry.

    The first digit of an entry is its level; texts without terms have a level of their own.
    """

    def entries(fingerprint: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(fingerprint), F.lit(_ENTRY))
        return F.transform(places, lambda at: F.substr(fingerprint, at, F.lit(_ENTRY)))

    def beginnings(held: Column, digits: int) -> Column:
        return F.transform(held, lambda entry: F.left(entry, F.lit(digits)))

    def shares(equal: Column, either: Column) -> Column:
        def share(level: Column) -> Column:
            def of_level(held: Column) -> Column:
                return F.size(F.filter(held, lambda x: F.left(x, F.lit(1)) == level))

            return of_level(equal) / of_level(either)

        levels = F.array_sort(F.array_distinct(beginnings(either, 1)))
        return let(levels, lambda held: F.aggregate(held, F.lit(0.0), lambda sum, x: sum + share(x)) / F.size(held))

    def of_entries(a: Column, b: Column) -> Column:
        either = F.array_union(beginnings(a, SUBSET_DIGITS), beginnings(b, SUBSET_DIGITS))
        return let(F.array_intersect(a, b), lambda equal: let(either, lambda held: shares(equal, held)))

    return let(entries(one), lambda a: let(entries(other), lambda b: of_entries(a, b)))


def _in_order(docs: DataFrame) -> DataFrame:
    """One row per different (id, hash): copies, and the key and length of the row before it, in a circle.

    ``hash`` covers the text and whether doc_id is NULL; such rows come first.
    """
    narrow = docs.groupBy("present", "id", "hash").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    ranked = materialize(numbered(narrow, ["present", "id", "hash"], "rank", start=0, label="order"), "ranks")
    n_rows = ranked.count()
    before = ranked.select(
        F.col("id").alias("before_id"),
        F.col("hash").alias("before_hash"),
        F.col("n").alias("before_n"),
        ((F.col("rank") + 1) % max(1, n_rows)).alias("rank"),
    )
    return ranked.join(before, "rank").select("present", "id", "hash", "copies", "before_id", "before_hash", "before_n")


def edited_fingerprints(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of an edited text, and the likeness to both neighbours.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points replaced by the first as many (or all) of the
    next document by doc_id; after the last comes the first.  Rows without doc_id come first; rows with one doc_id follow each
    other by a hash of the text, and equal rows are each other's next.  NULL texts are empty.  A table of one row is
    its own next; an empty table gives an empty one.  Other columns are not looked at.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    settings = settings or Settings()
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = materialize(lexicon(given, settings), "lexicon")
    rows = given.select(
        F.col("doc_id").isNotNull().alias("present"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("hash"),
        F.length("text").cast("bigint").alias("n"),
        "text",
    )
    order = materialize(_in_order(rows), "in-order")
    key = ["id", "hash"]
    # Both sides of the join below read all columns of this, so the texts are shuffled once.
    placed = rows.groupBy(*key).agg(F.first("text").alias("text")).join(order, key)
    heads = placed.select(
        F.col("before_id").alias("id"),
        F.col("before_hash").alias("hash"),
        F.substr("text", F.lit(1), (F.col("before_n") / 2).cast("int")).alias("head"),
    )
    half = (F.length("text") / 2).cast("int")

    def version(number: int, text: Column) -> Column:
        return F.struct(F.lit(number).alias("version"), text.alias("text"))

    def edited(head: Column) -> Column:
        return F.concat(F.substr("text", F.lit(1), F.length("text") - half), head)

    # Of several equal rows all but the last have themselves as the next one.
    repeated = F.when(F.col("copies") > 1, version(2, edited(F.substr("text", F.lit(1), half))))
    versions = F.array(version(0, F.col("text")), version(1, edited(F.col("head"))), repeated)
    of_row = F.struct("present", "copies", "before_id", "before_hash")
    texts = placed.join(heads, key).select(
        *key, of_row.alias("of_row"), F.explode(F.array_compact(versions)).alias("v")
    )
    texts = texts.select(
        *key,
        "of_row",
        "v.*",
        F.length("v.text").alias("n_chars"),
        F.sha2(F.col("v.text").cast("binary"), 256).alias("sha256"),
    )
    keep = ["of_row", "n_chars", "sha256"]
    prints = fingerprinted(texts, known, [*key, "version"], keep, settings)

    def of_version(number: int) -> Column:
        # As bytes, they take half the room on the way.
        packed = F.struct(*(F.unhex(name).alias(name) for name in ("sha256", "fingerprint")))
        of_it = F.when(F.col("version") == number, packed)
        return F.first(of_it, ignorenulls=True).alias(f"version_{number}")

    own_length = F.first(F.when(F.col("version") == 0, F.col("n_chars")), ignorenulls=True)
    by_row = materialize(
        prints.groupBy(*key)
        .agg(F.first("of_row").alias("of_row"), own_length.alias("n_chars"), *map(of_version, range(3)))
        .select(*key, "of_row.*", "n_chars", *(f"version_{number}" for number in range(3))),
        "fingerprints",
    )
    nexts = by_row.select(
        F.col("before_id").alias("id"),
        F.col("before_hash").alias("hash"),
        F.col("version_0.fingerprint").alias("next_fingerprint"),
    )
    own = F.col("version_0.fingerprint")

    def hex_of(value: Column) -> Column:
        return F.lower(F.hex(value))

    def outcome(edit: Column, following: Column) -> Column:
        return F.struct(
            hex_of(edit["sha256"]).alias("edited_sha256"),
            hex_of(own).alias("fingerprint"),
            hex_of(edit["fingerprint"]).alias("edited_fingerprint"),
            likeness(hex_of(own), hex_of(edit["fingerprint"])).alias("near_edited"),
            likeness(hex_of(own), hex_of(following)).alias("near_next"),
        )

    copies = by_row.join(nexts, key).withColumn("nr", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    last = F.col("nr") == F.col("copies")
    row = F.when(last, outcome(F.col("version_1"), F.col("next_fingerprint"))).otherwise(
        outcome(F.col("version_2"), own)
    )
    return copies.select(
        F.when(F.col("present"), F.col("id")).alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"), row.alias("row")
    ).select("doc_id", "n_chars", "row.*")
