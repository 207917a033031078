"""Periodic runs: stretches of words that repeat with a period, found by a suffix automaton.

A run is a stretch with smallest period q and a length of at least ``max(least_words,
least_periods * q)`` that no neighbouring word extends.

* The words of a stretch are appended one by one to a suffix automaton.  The suffixes of the first
  i words are the path from the state of that prefix up the suffix links; the colour of a state is the place
  where its words last ended.
* The access of a link-cut tree recolours that path with i.  Before, the path falls into segments of one
  colour; the lengths of the deepest states of a segment with colour e say how long a suffix ends both at e and
  at i.  If it is no shorter than the distance i - e, both occurrences meet or overlap: a square of period
  i - e.  Such a suffix cannot be extended to the left, and the distance is its smallest period, because it
  is the last occurrence.  Where the word after i does not keep the period it is a run.
* The states do not change while colours do, so the automaton is built first and its link tree is cut
  into heavy paths.  Each keeps its coloured segments on a stack, so an access pops the segments that
  it recolours, and all accesses together cost n log n steps.

Every window of eight words inside a run occurs again a period away, which is a third of the run at most.
Only stretches of windows that do (by a rolling hash; a collision costs time, not results) get an
automaton.  It takes about a kilobyte a word of such a stretch.

A document is the unit of work: its words, whole, in one Python worker.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import let, space_words, travels_with_the_job, whole_quotient

travels_with_the_job(__name__)

#: Words of the windows that must repeat inside a run; fits runs of 24 words or three periods.
WINDOW = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start: bigint, length: bigint, period: bigint>"


@dataclass(frozen=True)
class Settings:
    least_words: int = 24
    least_periods: int = 3

    def __post_init__(self) -> None:
        # L - WINDOW - q >= q - 1 for all q, so that the windows cover the run.
        if self.least_periods < 3 or self.least_words < 3 * WINDOW:
            raise ValueError(f"runs have at least three periods and {3 * WINDOW} words")

    def least_length(self, period: int) -> int:
        return max(self.least_words, self.least_periods * period)


def _stretches(ids: np.ndarray, settings: Settings) -> list[tuple[int, int]]:
    """(first word, word after the last) of the stretches that hold all runs, in order."""
    n = len(ids)
    if n < settings.least_words:
        return []
    values = ids.astype(np.uint64) + np.uint64(1)
    windows = n - WINDOW + 1
    hashed = np.zeros(windows, np.uint64)
    for k in range(WINDOW):
        hashed = hashed * _FACTOR + values[k : k + windows]
    order = np.argsort(hashed, kind="stable")
    again = hashed[order[1:]] == hashed[order[:-1]]
    if not again.any():
        return []
    # The distance to the next place with the same window, on either side.
    before, after = order[:-1][again], order[1:][again]
    nearest = np.full(windows, n, np.int64)
    nearest[before] = after - before
    nearest[after] = np.minimum(nearest[after], after - before)

    held, waiting = [], [(0, windows)]
    while waiting:
        first, last = waiting.pop()
        most = (last - first + WINDOW - 1) // settings.least_periods
        near = np.concatenate(([False], nearest[first:last] <= most, [False]))
        edges = np.flatnonzero(near[1:] != near[:-1]) + first
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + WINDOW - 1 < settings.least_words:
                continue
            # A shorter stretch allows shorter periods only: look again while it still shrinks.
            (waiting if 3 * (b - a) < 2 * (last - first) else held).append((a, b))
    return [(a, b + WINDOW - 1) for a, b in sorted(held)]


def _automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and length of each state, and the state of each prefix."""
    moves: list[dict[int, int]] = [{}]
    link, length, prefixes = [-1], [0], []
    last = 0
    for word in ids:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and word not in moves[at]:
            moves[at][word] = now
            at = link[at]
        if at != -1:
            to = moves[at][word]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                copy = len(moves)
                moves.append(moves[to].copy())
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[now] = copy
                while at != -1 and moves[at].get(word) == to:
                    moves[at][word] = copy
                    at = link[at]
        prefixes.append(now)
        last = now
    return link, length, prefixes


def _path_tops(link: list[int], length: list[int]) -> list[int]:
    """The uppermost state of the heavy path of each state; the root is a path of its own."""
    upwards = np.argsort(np.array(length), kind="stable").tolist()
    size, heavy = [1] * len(link), [-1] * len(link)
    for state in reversed(upwards[1:]):
        up = link[state]
        size[up] += size[state]
        if heavy[up] == -1 or size[state] > size[heavy[up]]:
            heavy[up] = state
    tops = list(range(len(link)))
    for state in upwards[1:]:
        up = link[state]
        if up and heavy[up] == state:
            tops[state] = tops[up]
    return tops


def _runs_of_stretch(ids: list[int], settings: Settings) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch."""
    link, length, prefixes = _automaton(ids)
    tops = _path_tops(link, length)
    # Per heavy path: (length of the deepest state, colour), the segment next to the top last.
    segments: dict[int, list[tuple[int, int]]] = {}
    found = []
    n = len(ids)
    for i, state in enumerate(prefixes):
        here: dict[int, int] = {}
        while state:
            top, reach = tops[state], length[state]
            stack = segments.setdefault(top, [])
            deep = 0
            while stack and stack[-1][0] <= reach:
                deep, end = stack.pop()
                if deep >= 2 * (i - end):
                    here[i - end] = max(deep, here.get(i - end, 0))
            if stack and deep < reach and reach >= 2 * (i - stack[-1][1]):
                period = i - stack[-1][1]
                here[period] = max(reach, here.get(period, 0))
            stack.append((reach, i))
            state = link[top]
        for period, shared in here.items():
            whole = shared + period
            if whole >= settings.least_length(period) and (i + 1 == n or ids[i + 1] != ids[i + 1 - period]):
                found.append((i + 1 - whole, whole, period))
    return found


def runs_of_words(words: list, settings: Settings | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start and period."""
    settings = settings or Settings()
    if len(words) < settings.least_words:
        return []
    ids = np.fromiter(map({}.setdefault, words, range(len(words))), np.int64, len(words))
    runs = []
    for first, last in _stretches(ids, settings):
        for start, length, period in _runs_of_stretch(ids[first:last].tolist(), settings):
            runs.append((first + start, length, period))
    return sorted(set(runs), key=lambda run: (run[0], run[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(docs: DataFrame, keep: list[str], settings: Settings | None = None) -> DataFrame:
    """The columns ``keep`` of every row, n_words, runs and collapsed.

    ``runs`` lists start, length and period by start and period, ``collapsed`` is the text of the kept words joined by
    one space.  Words are ``[^\\x20\\x09-\\x0D]+``.  NULL, empty and blank texts have no words, no runs and
    an empty collapsed text.  Repeated rows are repeated, other columns of ``docs`` are not looked at, and an empty
    table gives an empty one.
    """
    settings = settings or Settings()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(0):
                words = (text.as_py() or b"").split()
                found = runs_of_words(words, settings)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed(words, found)))
            made = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
            columns = [
                *batch.columns[1:],
                pa.array(counts, pa.int64()),
                pa.array(runs, pa.list_(made)),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("text").cast("binary").alias("_text"), *keep)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(of_batches, f"{kept}n_words bigint, runs array<{RUN}>, collapsed string")


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text that the query looks at: a tenth of the documents are made periodic from a word on.

    Let h be the CRC of the decimal doc_id and g = h div 10.  If h ends in 0 and the text has n > 0
    words, each word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    Rows without doc_id stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = whole_quotient(h, F.lit(10))

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + whole_quotient(n - a, 3 + g % 8)
        last = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), last), " ")

    rewritten = let(space_words(text), lambda words: F.when(F.size(words) > 0, periodic(words)).otherwise(text))
    return F.when(h % 10 == 0, rewritten).otherwise(text)


def run_digests(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the run of the greatest exponent, and digests.

    Ties for the greatest length / period go to the smallest start, then the smallest period; without a run
    start, length, period and exponent_milli are NULL.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        with_planted_runs(F.col("doc_id").cast("bigint"), F.col("text")).alias("text"),
    )
    found = periodic_runs(rows, ["doc_id"], settings)
    best = F.aggregate(
        "runs",
        F.lit(None).cast(RUN),
        lambda best, run: F.when(
            best.isNull()
            | (run["length"].cast("decimal(19,0)") * best["period"] > best["length"].cast("decimal(19,0)") * run["period"]),
            run,
        ).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        whole_quotient(1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
