"""Benchmark decontamination by templates.

A text becomes a template: numbers, names and units are replaced by typed placeholders, the
other words are lower-cased.  Benchmark items with one template and one pattern of equal slots
are one class.  Documents and classes meet in a hash join of five-word template windows.

* A document that holds half of a class's windows holds one of any half of them and one more;
  so only such windows of each class are joined with all documents, and no match is lost.
* These are the windows whose first word (the first that is no placeholder) the fewest classes have.  A document only
  gets windows where such a word stands; a text without any has neither template nor windows.
* For the pairs found, all windows are compared by place.  Within one alignment every slot of the
  class must have one value in the document: a question with other numbers and names
  counts as the same question, a text that merely has the same shape does not.

A template window counts if at least three of its words are no placeholders.

Beside the templates, the lower-cased words of every item have windows of their own, numbers and names
as they are.  They find copies in another case and items that are mostly numbers or names.  An item of
three or four words is one such window; a shorter one is looked for as a whole document only.  A document
matches a class if either kind reaches the share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm.columns import let
from keyweave.session import materialize

NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
SLOTS = (NUMBER, NAME, UNIT)
#: Begins the hash of a window of words as they are.
PLAIN = "\x04"
#: Units that are placeholders after a number.
UNITS = (
    "mm cm m km in ft yd mi miles mg g kg t lb lbs oz ml l litres liters s sec seconds min minutes h hours days "
    "weeks months years percent dollars euros pounds cents usd eur gbp kmh mph kwh w kw v hz khz mhz ghz kb mb gb tb"
).split()
_NUMBERS = r"(?<![\p{L}\p{N}])\p{N}+(?![\p{L}\p{N}])"
_NAMES = r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}[\p{L}\p{N}]*"
_UNITS = rf"(?i)(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
_BETWEEN = rf"[^\p{{L}}\p{{N}}{''.join(SLOTS)}]+"


@dataclass(frozen=True)
class Settings:
    window: int = 5
    least_words: int = 3
    least_share: float = 0.5
    #: Tables up to so many rows (of two numbers) are broadcast, larger ones shuffled.
    most_broadcast: int = 1_000_000
    #: Up to so many first words of windows are looked for in the texts; with more of them all windows are joined.
    most_first_words: int = 20_000


def _pieces(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def template(text: Column) -> Column:
    """The words of a text, lower-cased, with placeholders for numbers, names and units."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), _NAMES, NAME)
    numbered = F.regexp_replace(F.regexp_replace(named, _NUMBERS, NUMBER), _UNITS, UNIT)
    return _pieces(F.lower(F.when(named.rlike(r"\p{N}"), numbered).otherwise(named)))


def originals(text: Column) -> Column:
    """The same words as they stand in the text."""
    return _pieces(F.coalesce(text, F.lit("")))


def windows(words: Column, size: int) -> Column:
    """A hash for each window; the whole template if it is shorter than one."""

    def hashed(held: Column) -> Column:
        return (
            F.when(
                F.size(held) >= size,
                F.transform(
                    F.sequence(F.lit(0), F.size(held) - size),
                    lambda i: F.xxhash64(*(F.get(held, i + j) for j in range(size))),
                ),
            )
            .when(F.size(held) > 0, F.array(F.xxhash64(F.array_join(held, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words, hashed)


def plain_windows(text: Column, sizes: list[int], least: int) -> Column:
    """at, hash and first word for each window of lower-cased words; the whole text if it has fewer than ``least``."""

    def of_size(held: Column, size: int) -> Column:
        starts = F.when(F.size(held) >= size, F.sequence(F.lit(0), F.size(held) - size))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.struct(i.alias("at"), _plain_hash(held, i, size).alias("hash"), F.get(held, i).alias("first")),
        )

    def hashed(held: Column) -> Column:
        none = F.lit(None).cast("string").alias("first")
        whole = F.struct(F.lit(0).alias("at"), _plain_whole(held).alias("hash"), none)
        return F.when((F.size(held) > 0) & (F.size(held) < least), F.array(whole)).otherwise(
            F.concat(*(of_size(held, size) for size in sizes))
        )

    return let(originals(F.lower(text)), hashed)


def _plain_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(PLAIN), *(F.get(words, at + j) for j in range(size)))


def _plain_whole(words: Column) -> Column:
    return F.xxhash64(F.lit(PLAIN), F.array_join(words, " "))


def _typed_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(size)))


FirstWords = dict[int, list[str]]


def windows_of(text: Column, sizes: list[int], settings: Settings, first_words: FirstWords | None = None) -> Column:
    """at, hash and words (as they stand in the text) of the windows of a document, of both kinds.

    ``first_words`` has the words that windows begin with, by the number of placeholders before them; without it
    all windows are given.  ``sizes`` are those of the windows of words as they are.
    """
    size, least = settings.window, settings.least_words

    def struct(at: Column, hashed: Column, values: Column, n: int) -> Column:
        return F.struct(at.alias("at"), hashed.alias("hash"), F.slice(values, at + 1, F.lit(n)).alias("values"))

    def begins(held: Column, at: Column) -> Column:
        found = F.lit(False)
        for before, words in first_words.items():
            found = found | F.coalesce(F.get(held, at + before).isin(words), F.lit(False))
        return found

    def typed(places: Column, values: Column) -> Column:
        def hashed(held: Column) -> Column:
            whole = F.array(struct(F.lit(0), F.xxhash64(F.array_join(held, " ")), values, size))
            some = F.filter(places, lambda i: i <= F.size(held) - size)
            each = F.transform(some, lambda i: struct(i, _typed_hash(held, i, size), values, size))
            return F.when(F.size(held) < size, whole).otherwise(each)

        return let(template(text), hashed)

    def plain(places: Column, held: Column, values: Column) -> Column:
        whole = F.array(struct(F.lit(0), _plain_whole(held), values, size))

        def of_size(n: int) -> Column:
            some = F.filter(places, lambda i: i <= F.size(held) - n)
            return F.transform(some, lambda i: struct(i, _plain_hash(held, i, n), values, size))

        return F.when(F.size(held) < least, whole).otherwise(F.concat(*map(of_size, sizes)))

    def of_places(held: Column, places: Column) -> Column:
        return let(originals(text), lambda values: F.concat(typed(places, values), plain(places, held, values)))

    def of_words(held: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(held) - 1)
        if first_words is None:
            return F.when(F.size(held) > 0, of_places(held, every))
        some = F.filter(every, lambda i: (F.size(held) < size) | begins(held, i))
        return F.when(
            F.size(held) > 0, let(some, lambda places: F.when(F.size(places) > 0, of_places(held, places)))
        )

    return let(originals(F.lower(text)), of_words)


def _is_slot(word: Column) -> Column:
    return word.isin(*SLOTS)


def classes(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """One row per window of each class: group, class, item_id, place, hash, slots, before, first, n_windows, rank.

    ``item_id`` is the smallest of the group, the items of one template; ``slots`` has for each word of the
    window the number of its slot, or NULL; ``first`` is its first word that is no placeholder, ``before`` the number of those;
    ``rank`` counts from the window whose first word the fewest classes have.
    The template is one class of the group, and the words of each of its items are one more.
    """
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        template(F.col("text")).alias("words"),
        originals(F.col("text")).alias("values"),
        "text",
    )
    slots = F.transform(
        F.col("words"),
        lambda word, i: F.when(
            _is_slot(word), F.array_position(F.col("values"), F.get(F.col("values"), i)).cast("int")
        ),
    )
    numbered = items.withColumn("slots", slots)
    group = F.xxhash64("words", "slots").alias("group")
    distinct = numbered.groupBy("words", "slots").agg(F.min("item_id").alias("item_id"))
    first = distinct.select(group, "item_id")
    as_they_are = numbered.select(group, F.lower(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    plain = F.lit(None).cast("array<int>").alias("slots")
    n_words = F.size(originals(F.col("text")))
    own_size = F.when(n_words >= settings.window, settings.window).otherwise(n_words)
    sizes = range(settings.least_words, settings.window + 1)
    of_own_size = F.coalesce(
        *(
            F.when(own_size == size, plain_windows(F.col("text"), [size], settings.least_words))
            for size in sizes
        ),
        plain_windows(F.col("text"), [settings.window], settings.least_words),
    )
    spelled = (
        as_they_are.select(
            "group", F.xxhash64(F.lit(PLAIN), "group", "text").alias("class"), F.explode(of_own_size).alias("w")
        )
        .join(first, "group")
        .select(
            "group",
            "class",
            "item_id",
            F.col("w.at").alias("place"),
            F.col("w.hash").alias("hash"),
            plain,
            F.lit(0).alias("before"),
            F.col("w.first").alias("first"),
        )
    )
    own_words = F.slice("words", F.col("place") + 1, settings.window)
    before = F.array_position(F.transform(own_words, lambda w: ~_is_slot(w)), True).cast("int") - 1
    placed = distinct.select(
        group,
        F.xxhash64("words", "slots").alias("class"),
        "item_id",
        "words",
        "slots",
        F.posexplode(windows(F.col("words"), settings.window)).alias("place", "hash"),
    ).select(
        "group",
        "class",
        "item_id",
        "place",
        "hash",
        F.slice("slots", F.col("place") + 1, settings.window).alias("slots"),
        before.alias("before"),
        F.get(own_words, before).alias("first"),
        F.size(F.filter(own_words, lambda w: ~_is_slot(w))).alias("plain"),
        F.size("words").alias("n_words"),
    )
    least = F.least(F.lit(settings.least_words), F.col("n_words"))
    counted = materialize(placed.where(F.col("plain") >= least).drop("plain", "n_words").union(spelled), "windows")
    sharing = counted.groupBy("hash").agg(F.count_distinct("class").alias("sharing"))
    often = counted.groupBy("first").agg(F.count_distinct("class").alias("often"))
    # Both windows run within one class: the places of one benchmark item.
    own = Window.partitionBy("class")
    return materialize(
        counted.join(sharing, "hash")
        .join(often, "first", "left")
        .withColumn("n_windows", F.count("*").over(own))
        .withColumn("rank", F.row_number().over(own.orderBy("often", "sharing", "place"))),
        "classes",
    )


def _first_words(rare: DataFrame, settings: Settings) -> FirstWords | None:
    """The words that the windows begin with, by the number of placeholders before; None if there are too many."""
    words = rare.where("first is not null").select("before", "first").distinct()
    if words.count() > settings.most_first_words:
        return None
    found: FirstWords = {0: []}
    for row in words.collect():
        found.setdefault(row["before"], []).append(row["first"])
    return found


def _small(table: DataFrame, settings: Settings) -> DataFrame:
    return F.broadcast(table) if table.count() <= settings.most_broadcast else table


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(key, item_id, share) for each document and class that match.

    ``docs`` has key (a number per different document) and text.
    """
    settings = settings or Settings()
    known = classes(benchmark, settings)
    enough = F.ceil(F.col("n_windows") * settings.least_share)
    rare = materialize(
        known.where(F.col("rank") <= F.col("n_windows") - enough + 1).select("hash", "class", "before", "first").distinct(),
        "rare",
    )
    lengths = benchmark.select(F.size(originals(F.lower("text"))).alias("n")).distinct()
    short = lengths.where((F.col("n") >= settings.least_words) & (F.col("n") < settings.window)).collect()
    sizes = [settings.window, *sorted(r["n"] for r in short)]

    first_words = _first_words(rare, settings)
    found = docs.select("key", F.explode(windows_of(F.col("text"), sizes, settings, first_words)).alias("w"))
    hashes = found.select("key", F.col("w.hash").alias("hash"))
    wanted = rare.select("hash", "class").distinct()
    pairs = materialize(hashes.join(_small(wanted, settings), "hash").select("key", "class").distinct(), "pairs")

    keys = materialize(pairs.select("key").distinct(), "keys")
    some = docs.join(_small(keys, settings), "key", "left_semi").dropDuplicates(["key"])
    placed = some.select("key", F.explode(windows_of(F.col("text"), sizes, settings)).alias("w")).select("key", "w.*")
    met = materialize(
        placed.join(pairs, "key")
        .join(known, ["class", "hash"])
        .select(
            "key",
            "group",
            "class",
            "item_id",
            "n_windows",
            "place",
            (F.col("at") - F.col("place")).alias("shift"),
            F.arrays_zip("slots", "values").alias("words"),
        ),
        "met",
    )
    alignment = ["key", "class", "shift"]
    filled = met.select(*alignment, F.explode("words").alias("word")).where("word.slots is not null")
    broken = (
        filled.select(*alignment, "word.slots", "word.values")
        .distinct()
        .groupBy(*alignment, "slots")
        .count()
        .where("count > 1")
        .select(*alignment)
        .distinct()
    )
    return (
        met.join(broken, alignment, "left_anti")
        .groupBy("key", "group", "class", "item_id", "n_windows")
        .agg((F.count_distinct("place") / F.col("n_windows")).alias("share"))
        .where(F.col("share") >= settings.least_share)
        .groupBy("key", "group", "item_id")
        .agg(
            F.coalesce(
                F.max(F.when(F.col("class") == F.col("group"), F.col("share"))), F.max("share")
            ).alias("share")
        )
        .select("key", "item_id", "share")
    )


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def decontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, with the columns they came with.

    NULL and empty texts hold no item and stay.  Repeated rows stay or go together; an empty table stays empty, and an
    empty benchmark leaves all rows.
    """
    settings = settings or Settings()
    whole = docs.select(F.struct("*").alias("_row"), _key(F.col("doc_id"), F.col("text")).alias("key"))
    found = matches(whole.select("key", F.col("_row.text").alias("text")), benchmark, settings)
    leaks = materialize(found.select("key").distinct(), "leaks")
    return whole.join(_small(leaks, settings), "key", "left_anti").select("_row.*")


def contamination_of_documents(
    docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None
) -> DataFrame:
    """One row per document: doc_id, contaminated, n_classes, item_id, share.

    ``n_classes`` counts the matching classes of benchmark items, ``item_id`` is the smallest
    item of theirs and ``share`` the highest share of windows found (NULL and 0 without any), of template
    windows where these reach it.  NULL and
    empty texts have no window and match nothing; an item shorter than a window matches a
    document of just its template, and one of three words or more also a document that holds its words.  Repeated rows get equal results.  With an empty benchmark
    every document is clean.
    """
    settings = settings or Settings()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn(
        "key", _key(F.col("doc_id"), F.col("text"))
    )
    found = matches(rows.select("key", "text"), benchmark, settings)
    leaks = materialize(
        found.groupBy("key").agg(
            F.count("*").alias("n_classes"), F.min("item_id").alias("item_id"), F.max("share").alias("share")
        ),
        "leaks",
    )
    return rows.join(_small(leaks, settings), "key", "left").select(
        "doc_id",
        F.col("n_classes").isNotNull().alias("contaminated"),
        F.coalesce("n_classes", F.lit(0)).cast("bigint").alias("n_classes"),
        "item_id",
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )
