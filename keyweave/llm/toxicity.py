"""Toxicity: class-conditional Kneser-Ney models of expressions, compared per word.

An expression is a word, spelled character by character up to eight of them.  Each class,
toxic and ordinary, has a Kneser-Ney model of the next character after the beginning of a word;
the discounted mass of both goes to one shared model: continuation counts of character pairs
over the different beginnings of both classes.  So a rare beginning is judged by
its stem, and one that neither class knows speaks for neither.

The log-likelihood ratio of a word is the sum along its beginnings; it is followed as long as the
toxic model knows the beginning, and the step that leaves the model is counted too.  A
document is scored by what the ratios of its words exceed a margin by, over its number of
words, and a logistic curve, fitted on labelled rows that the counts have not seen, makes a
probability of it.

All labelled rows are counted, in Spark.  The scores per beginning are a table that grows with the corpus;
it is broadcast up to ``most_broadcast`` rows and joined beyond.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import travels_with_the_job
from keyweave.session import materialize

travels_with_the_job(__name__)

LONGEST = 8
END = "$"
DISCOUNT = 0.75
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    margin: float = 3.0
    threshold: float = 0.3
    #: One labelled row in so many at most sets the curve and is not counted.
    curve_part: int = 5
    #: Rows that the curve is fitted on, about; all others are counted.
    curve_rows: int = 20_000
    most_broadcast: int = 2_000_000
    most_broadcast_labels: int = 2_000_000


@dataclass(frozen=True)
class Model:
    """``lexicon``: (prefix, whole, exit) as a written table; the curve's two numbers."""

    lexicon: DataFrame
    broadcast: bool
    slope: float
    shift: float


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def form_of(word: str) -> str:
    """What the models see of a word: eight characters, or fewer and an end mark."""
    return word[:LONGEST] if len(word) >= LONGEST else word + END


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned; a row without doc_id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text, toxic) of the rows to learn from; several labels of a document: the highest."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= settings.most_broadcast_labels:
        known = F.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.where(~held_out(F.col("doc_id"))).join(known, "doc_id")


def _for_curve(settings: Settings, n_rows: int) -> Column:
    """The rows that set the curve, of ``n_rows``: one in ``curve_part``, or fewer if that is more than ``curve_rows``."""
    part = max(settings.curve_part, -(-n_rows // settings.curve_rows))
    return F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(part)) == 0


def _beginnings(rows: DataFrame, most_words: int = 80_000) -> DataFrame:
    """(prefix, toxic, ordinary): how often each class has each beginning of a form."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            counts: dict[str, list[int]] = {}
            for label, words in enumerate(seen):
                for word, n in words.items():
                    form = form_of(word)
                    for end in range(1, len(form) + 1):
                        counts.setdefault(form[:end], [0, 0])[label] += n
                words.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                ],
                names=["prefix", "toxic", "ordinary"],
            )

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(words_of(text.as_py()))
                if len(seen[0]) + len(seen[1]) > most_words:
                    yield flushed()
        yield flushed()

    found = rows.select("text", "toxic").mapInArrow(of_batches, "prefix string, toxic bigint, ordinary bigint")
    return found.groupBy("prefix").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _shared(prefixes: DataFrame) -> DataFrame:
    """(ending, shared): the shared probability of a last character, after the one before it.

    Counts are continuation counts: of different beginnings, whatever their class.
    """
    last = F.right("prefix", F.lit(1))
    singles = prefixes.groupBy(last.alias("last")).agg(F.count("*").alias("n"))
    whole = singles.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    total, kinds = whole["n"] or 0, whole["kinds"] + 1
    one = singles.select("last", ((F.col("n") + 0.5) / (total + 0.5 * kinds)).alias("base"))
    pairs = (
        prefixes.where(F.length("prefix") >= 2)
        .groupBy(F.right("prefix", F.lit(2)).alias("ending"))
        .agg(F.count("*").alias("n"))
        .withColumns({"before": F.left("ending", F.lit(1)), "last": F.right("ending", F.lit(1))})
    )
    after = pairs.groupBy("before").agg(F.sum("n").alias("n_after"), F.count("*").alias("kinds_after"))
    left = F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds_after") * F.col("base")
    two = pairs.join(after, "before").join(one, "last").select("ending", (left / F.col("n_after")).alias("shared"))
    return one.select(F.col("last").alias("ending"), F.col("base").alias("shared")).union(two)


def lexicon(rows: DataFrame, margin: float) -> DataFrame:
    """(prefix, whole, exit): log-likelihood ratios of forms by the longest known beginning.

    ``whole`` holds if the form is the beginning, ``exit`` if it goes on otherwise.
    """
    prefixes = materialize(_beginnings(rows), "beginnings")
    parent = F.left("prefix", F.length("prefix") - 1)
    after = prefixes.groupBy(parent.alias("parent")).agg(
        F.sum("toxic").alias("n1"),
        F.sum("ordinary").alias("n0"),
        F.count_if(F.col("toxic") > 0).alias("kinds1"),
        F.count_if(F.col("ordinary") > 0).alias("kinds0"),
    )

    def chance(count: str, kinds: str, n: str) -> Column:
        kept = F.greatest(F.col(count) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * F.col("shared")
        return F.when(F.col(n) > 0, kept / F.col(n)).otherwise(F.col("shared"))

    def passed_on(kinds: str, n: str) -> Column:
        return F.when(F.col(n) > 0, DISCOUNT * F.col(kinds) / F.col(n)).otherwise(F.lit(1.0))

    steps = (
        prefixes.withColumns({"parent": parent, "ending": F.right("prefix", F.lit(2))})
        .join(after, "parent")
        .join(_shared(prefixes), "ending")
        .select(
            "prefix",
            "parent",
            "toxic",
            F.ln(chance("toxic", "kinds1", "n1") / chance("ordinary", "kinds0", "n0")).alias("step"),
        )
    )
    steps = materialize(steps, "steps")
    known = steps.where("toxic > 0")
    ancestors = known.select(
        F.col("prefix").alias("node"), F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("n")
    ).select("node", F.expr("left(node, n)").alias("prefix"))
    whole = (
        ancestors.join(known.select("prefix", "step"), "prefix")
        .groupBy(F.col("node").alias("prefix"))
        .agg(F.sum("step").alias("whole"))
    )
    exits = after.select(
        F.col("parent").alias("prefix"), F.ln(passed_on("kinds1", "n1") / passed_on("kinds0", "n0")).alias("leave")
    )
    nodes = whole.join(exits, "prefix", "left").select(
        "prefix", "whole", (F.col("whole") + F.coalesce("leave", F.lit(0.0))).alias("exit")
    )
    # A beginning that only ordinary texts have ends the comparison; it matters where going on counts.
    left = nodes.where(F.col("exit") > margin).select(F.col("prefix").alias("parent"), "whole")
    ends = steps.where("toxic = 0").join(left, "parent").select("prefix", (F.col("whole") + F.col("step")).alias("whole"))
    return materialize(nodes.union(ends.select("prefix", "whole", F.col("whole").alias("exit"))), "lexicon")


class WordScores(dict):
    """What a word's ratio exceeds the margin by; two generations bound the memory."""

    def __init__(self, table: dict[str, tuple[float, float]], margin: float, most: int = 80_000):
        super().__init__()
        self.table, self.margin, self.most, self.older = table, margin, most, {}

    def of_form(self, form: str) -> float:
        for end in range(len(form), 0, -1):
            found = self.table.get(form[:end])
            if found:
                return max(0.0, found[end < len(form)] - self.margin)
        return 0.0

    def __missing__(self, word: str) -> float:
        value = self.older.get(word)
        if value is None:
            value = self.of_form(form_of(word))
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


def _pruned(rows: pa.Table, margin: float) -> dict[str, tuple[float, float]]:
    """The part of the lexicon that can score above the margin, or hides a beginning that can."""
    prefixes, whole, leave = (rows.column(name).to_pylist() for name in ("prefix", "whole", "exit"))
    kept: dict[str, tuple[float, float]] = {}
    for at in sorted(range(len(prefixes)), key=lambda i: len(prefixes[i])):
        prefix = prefixes[at]
        hides = any(prefix[:end] in kept for end in range(len(prefix) - 1, 0, -1))
        if hides or max(whole[at], leave[at]) > margin:
            kept[prefix] = (whole[at], leave[at])
    return kept


def _evidence(rows: DataFrame, model: Model, keep: list[str], settings: Settings) -> DataFrame:
    """``keep`` of every row and ``evidence``: excess over the margin, per word."""
    if not model.broadcast:
        return _evidence_by_join(rows, model.lexicon, keep, settings)
    shared = rows.sparkSession.sparkContext.broadcast(_pruned(model.lexicon.toArrow(), settings.margin))
    margin = settings.margin

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(shared.value, margin)
        for batch in batches:
            evidence = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                evidence.append(sum(map(scores.__getitem__, words)) / len(words) if words else 0.0)
            columns = [*batch.columns[1:], pa.array(evidence, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "evidence"])

    asked = rows.select("text", *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[1:])
    return asked.mapInArrow(of_batches, f"{kept}, evidence double")


def _evidence_by_join(rows: DataFrame, table: DataFrame, keep: list[str], settings: Settings) -> DataFrame:
    """The same by a join, for a lexicon of any size."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                words = words_of(text.as_py())
                for form, n in Counter(map(form_of, words)).items():
                    found.append((row, form, n, n / len(words)))
            columns = zip(*found, strict=True) if found else [[]] * 4
            types = [pa.int64(), pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                names=["row", "form", "n", "share"],
            )

    numbered = materialize(rows.select("text", *keep).withColumn("row", F.monotonically_increasing_id()), "rows")
    forms = numbered.select("text", "row").mapInArrow(of_batches, "row bigint, form string, n bigint, share double")
    distinct = forms.select("form").distinct()
    prefixes = distinct.select("form", F.explode(F.sequence(F.lit(1), F.length("form"))).alias("n"))
    value = F.when(F.col("prefix") == F.col("form"), F.col("whole")).otherwise(F.col("exit"))
    best = (
        prefixes.select("form", F.expr("left(form, n)").alias("prefix"))
        .join(table, "prefix")
        .groupBy("form")
        .agg(F.max_by(value, F.length("prefix")).alias("ratio"))
        .select("form", (F.col("ratio") - settings.margin).alias("excess"))
        .where("excess > 0")
    )
    sums = forms.join(best, "form").groupBy("row").agg(F.sum(F.col("share") * F.col("excess")).alias("evidence"))
    return numbered.join(sums, "row", "left").select(*keep, F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def _scaled(evidence):
    return np.log(evidence + 1e-3)


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over log evidence, by Newton's method, slightly held back."""
    if not 0 < toxic.sum() < len(toxic):
        return 4.0, -4.0 * float(_scaled(np.array(0.1)))  # one half at an evidence of 0.1
    z = _scaled(evidence)
    x = np.column_stack([z, np.ones_like(z)])
    beta = np.zeros(2)
    hold = np.diag([0.05, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - toxic) + hold @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold + 1e-9 * np.eye(2), gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def trained(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """The models of the labelled rows of ``docs`` that are not held out."""
    settings = settings or Settings()
    rows = _labelled(docs, labels, settings)
    for_curve = _for_curve(settings, rows.count())
    table = lexicon(rows.where(~for_curve), settings.margin)
    model = Model(table, table.count() <= settings.most_broadcast, 0.0, 0.0)
    unseen = _evidence(rows.where(for_curve), model, ["doc_id", "toxic"], settings)
    # About curve_rows by the draw; the limit only meets floods of rows with one doc_id.
    drawn = unseen.orderBy(F.xxhash64(F.lit("drawn"), "doc_id"), "toxic", "evidence").limit(2 * settings.curve_rows)
    seen = drawn.select("toxic", "evidence").toArrow()
    slope, shift = _curve(seen.column("evidence").to_numpy(), seen.column("toxic").to_numpy().astype(float))
    return Model(table, model.broadcast, slope, shift)


def scored(docs: DataFrame, model: Model, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    NULL, empty and wordless texts have no evidence and the lowest score.  Repeated rows get
    equal scores.
    """
    settings = settings or Settings()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = _evidence(rows, model, ["doc_id"], settings)
    logit = model.slope * F.ln(F.col("evidence") + 1e-3) + model.shift
    score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= settings.threshold).cast("int").alias("predicted"),
        "evidence",
    )


def toxicity_of_documents(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of the query.  Without labels the scores rest on no counts and are all low."""
    return scored(docs, trained(docs, labels, settings), settings)
