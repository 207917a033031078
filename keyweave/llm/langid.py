"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its byte n-grams, hashed into a table of fixed size;
a linear layer on top gives a score per language.  The model is trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows (``sample_rows``, the same share of
rows for every language where possible).  What comes to the driver of a sampled row are its n-gram
counts, taken from the whole text in a task, so a long text costs no more than the table has
buckets.  They come in parts of ``rows_at_once`` rows and go to a scratch file, from which training
reads them row by row; the driver's memory never holds the sample.

A fifth of the sample is not trained on.  It sets the temperature of the softmax, and the
score below which a text is rejected: the score that all but ``false_rejections`` of the
labelled rows reach, one half at most.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from keyweave.llm.columns import travels_with_the_job

travels_with_the_job(__name__)

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 4000
    rows_at_once: int = 500
    most_languages: int = 512
    dimensions: int = 16
    epochs: int = 12
    rate: float = 2.0
    false_rejections: float = 0.001
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``table`` holds embeddings and linear layer folded together: a row of scores per bucket."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often the byte n-grams of the lower-cased text fall into each bucket."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    found, gram = [], codes
    for order in range(2, max(ORDERS) + 1):
        if len(codes) < order:
            break
        gram = gram[:-1] * np.uint32(0x01000193) + codes[order - 1 :] + np.uint32(order)
        if order in ORDERS:
            mixed = gram * np.uint32(0x9E3779B1)
            found.append((mixed >> np.uint32(17)).astype(np.int64))
    return np.bincount(np.concatenate(found), minlength=BUCKETS)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows kept from learning: those of one remainder, and those without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def _sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """A bounded sample of labelled rows (text, lang, draw), by a hash of the row."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    sizes = labelled.groupBy("lang").count().orderBy("lang").limit(settings.most_languages + 1)
    sizes = {row["lang"]: row["count"] for row in sizes.collect()}
    if len(sizes) > settings.most_languages:
        raise ValueError(f"lang has more than {settings.most_languages} values; none is left out, so raise most_languages")
    if not sizes:
        return labelled.select("text", "lang", F.lit(0.0).alias("draw"))
    each = settings.sample_rows / len(sizes)
    shares = docs.sparkSession.createDataFrame(
        [(lang, each / size) for lang, size in sizes.items()], "lang string, share double"
    )
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = labelled.select("text", "lang", draw.alias("draw"))
    # most_languages rows at most are broadcast.
    return drawn.join(F.broadcast(shares), "lang").where("draw < share").select("text", "lang", "draw")


class Examples:
    """Sampled rows in the order of (lang, draw): languages in memory, n-gram counts in a scratch file."""

    def __init__(self, rows: Iterable[Row]):
        self._file = tempfile.TemporaryFile()
        places, end = [], 0
        for row in rows:
            cells = row["at"] + row["counts"]
            # Rows of one draw are copies, but for a clash of hashes.
            places.append((row["lang"], row["draw"], zlib.crc32(cells), end, len(row["at"]), len(row["counts"])))
            end += self._file.write(cells)
        self._places = sorted(places)
        self.langs = [place[0] for place in self._places]

    def __len__(self) -> int:
        return len(self._places)

    def __getitem__(self, i: int) -> tuple[str, np.ndarray, np.ndarray]:
        """(lang, buckets, weights) of a row."""
        lang, _, _, start, n_at, n_counts = self._places[i]
        self._file.seek(start)
        at = np.frombuffer(self._file.read(n_at), "<u2").astype(np.int32)
        counts = np.frombuffer(self._file.read(n_counts), f"<u{n_counts // len(at)}")
        return lang, at, (counts / counts.sum()).astype(np.float32)

    def __enter__(self) -> Examples:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()


def _features(sample: DataFrame, settings: Settings) -> Examples:
    """The n-gram counts of every sampled row that has a letter."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, langs, draws = (batch.column(i).to_pylist() for i in range(3))
            for text, lang, draw in zip(texts, langs, draws, strict=True):
                if has_letter(text):
                    counts = gram_counts(text)
                    at = np.flatnonzero(counts)
                    # Most counts take one byte, and every bucket two.
                    seen = counts[at].astype(np.min_scalar_type(counts.max()).newbyteorder("<"))
                    rows.append((lang, draw, at.astype("<u2").tobytes(), seen.tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            types = [pa.string(), pa.float64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                names=["lang", "draw", "at", "counts"],
            )

    found = sample.mapInArrow(of_batches, "lang string, draw double, at binary, counts binary")
    # About sample_rows are drawn; the limit only meets floods of equal rows.
    most_rows = 2 * settings.sample_rows
    parts = found.limit(most_rows).repartition(-(-most_rows // settings.rows_at_once))
    return Examples(parts.toLocalIterator())


def trained(docs: DataFrame, settings: Settings | None = None) -> Model | None:
    """The model of the labelled rows of ``docs`` (doc_id, text, lang); None if there are none."""
    settings = settings or Settings()
    with _features(_sample(docs, settings), settings) as rows:
        return _fitted(rows, settings) if rows else None


def _fitted(rows: Examples, settings: Settings) -> Model:
    languages = tuple(sorted(set(rows.langs)))
    label = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(rows))
    fit, check = order[len(rows) // 5 :], order[: len(rows) // 5]

    n, d = len(languages), settings.dimensions
    embedding = rng.uniform(-1 / d, 1 / d, (BUCKETS, d)).astype(np.float32)
    linear = rng.uniform(-1 / d, 1 / d, (d, n)).astype(np.float32)
    bias = np.zeros(n, dtype=np.float32)
    steps = settings.epochs * len(fit)
    step = 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(fit)):
            lang, at, weights = rows[fit[i]]
            rate = settings.rate * (1 - step / steps)
            hidden = weights @ embedding[at]
            error = _softmax(hidden @ linear + bias)
            error[label[lang]] -= 1
            back = linear @ error
            linear -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            # Every n-gram of a text gets the same direction; common ones are not favoured.
            embedding[at] -= (rate * back)[None, :] * np.minimum(1.0, weights * 64)[:, None]
            step += 1

    table = embedding @ linear
    held = check if len(check) else fit
    logits = np.array([weights @ table[at] + bias for _, at, weights in map(rows.__getitem__, held)])
    truth = np.array([label[rows.langs[i]] for i in held])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    best = _softmax(logits / temperature).max(axis=1)
    least = min(0.5, float(np.quantile(best, settings.false_rejections)))
    return Model(languages, table.astype(np.float32), bias, temperature, least)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def predicted(rows: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` of every row, with lang_pred, score and rejected.

    A text that is NULL or has no letter is ``und`` with score 0 and rejected, and so is every
    text without a model.  Any other text gets a learned language and its calibrated
    probability; it is rejected below the calibrated score.
    """
    # BUCKETS * most_languages at most; plain values, so that workers need no class of this package.
    plain = model and (model.languages, model.table, model.bias, model.temperature, model.least_score)
    shared = rows.sparkSession.sparkContext.broadcast(plain)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value) if shared.value else None
        for batch in batches:
            langs, scores, rejected = [], [], []
            for value in batch.column(0):
                text = value.as_py()
                if model is None or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                counts = gram_counts(text)
                logits = counts @ model.table / counts.sum() + model.bias
                odds = _softmax(logits / model.temperature)
                at = int(odds.argmax())
                langs.append(model.languages[at])
                scores.append(float(odds[at]))
                rejected.append(bool(odds[at] < model.least_score))
            columns = [*batch.columns[1:], pa.array(langs), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "rejected"])

    asked = rows.select(F.col(text), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[1:])
    return asked.mapInArrow(of_batches, f"{kept}, lang_pred string, score double, rejected boolean")


def languages_of_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of the query: doc_id, held_out, lang_pred, score, rejected.

    Rows without doc_id count as held out.  Repeated rows get equal predictions.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    model = trained(rows, settings)
    marked = rows.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return predicted(marked, model, ["doc_id", "held_out"])


def identified(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with the columns they came with.

    NULL, empty and letterless texts have no language and go.  Repeated rows stay or go together; an empty table
    stays empty, and without any labelled row every text goes.
    """
    model = trained(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"), settings)
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return predicted(whole, model, ["_row"], "_text").where("not rejected").select("_row.*")
