"""License scans: a positional index of rare license words.

The license templates are indexed by word and position.  A first pass counts in how many
documents each template word occurs, over all documents, so that the rare ones are known (IDF).
The second pass looks up, per template, the file's rarest words of it, and lets every
occurrence vote for the place where the template would begin.  Places with enough votes are
compared word by word, and the template's mandatory phrase must stand there in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import travels_with_the_job

travels_with_the_job(__name__)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Words that must stand in the matched place.
    phrase: str


#: The phrases of the contract: every place counts, whatever stands around it.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc0-1.0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        "with or without fee is hereby granted",
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software"),
)

#: Words are runs of letters and digits of ASCII, lower-cased, and of all other characters.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Settings:
    #: Rare words of a template that are looked up in a file.
    anchors: int = 4
    #: Share of a template's words that must stand at their places.
    least_share: float = 0.6


class Index:
    """Templates by word and position, and the words' IDF."""

    def __init__(self, templates, documents: int, frequency: dict[bytes, int]):
        self.labels = [t.label for t in templates]
        self.words = [t.text.encode().split() for t in templates]
        self.phrases = [t.phrase.encode().split() for t in templates]
        self.idf = {
            word: math.log((documents + 1) / (frequency.get(word, 0) + 1)) for words in self.words for word in words
        }
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for template, words in enumerate(self.words):
            for place, word in enumerate(words):
                self.places.setdefault(word, []).append((template, place))

    def matches(self, words: list[bytes], settings: Settings) -> dict[str, float]:
        """label -> best share of template words in place, for the verified templates."""
        held: dict[bytes, list[int]] = {}
        for at, word in enumerate(words):
            if word in self.places:
                held.setdefault(word, []).append(at)
        found: dict[str, float] = {}
        if not held:
            return found
        rarest = sorted(held, key=lambda word: (-self.idf[word], word))
        for template, wanted in enumerate(self.words):
            own = set(wanted)
            anchors = [word for word in rarest if word in own][: settings.anchors]
            if len(anchors) < min(settings.anchors, len(own)) / 2:
                continue
            votes: Counter[int] = Counter()
            for word in anchors:
                for of, place in self.places[word]:
                    if of == template:
                        votes.update(at - place for at in held[word])
            for start, n in votes.items():
                if n < max(1, len(anchors) // 2):
                    continue
                share = self._share(words, start, wanted)
                if share >= settings.least_share and self._stands(words, start, template):
                    label = self.labels[template]
                    found[label] = max(found.get(label, 0.0), share)
        return found

    @staticmethod
    def _share(words: list[bytes], start: int, wanted: list[bytes]) -> float:
        equal = sum(
            0 <= start + i < len(words) and words[start + i] == word for i, word in enumerate(wanted)
        )
        return equal / len(wanted)

    def _stands(self, words: list[bytes], start: int, template: int) -> bool:
        phrase, size = self.phrases[template], len(self.words[template])
        low, high = max(0, start), min(len(words), start + size) - len(phrase)
        return any(words[at : at + len(phrase)] == phrase for at in range(low, high + 1))


def _base_pattern(phrases) -> re.Pattern[bytes]:
    return re.compile(b"(?<= )(?:" + b"|".join(re.escape(p.encode()) for p in phrases) + b")(?= )")


def base_places(words: list[bytes], pattern: re.Pattern[bytes]) -> list[tuple[int, str]]:
    """(first word, phrase) of every place of a base phrase."""
    joined = b" " + b" ".join(words) + b" "
    found, at, word = [], 0, -1
    for match in pattern.finditer(joined):
        word += joined.count(b" ", at, match.start())
        at = match.start()
        found.append((word, match.group().decode()))
    return found


def template_frequency(docs: DataFrame, templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each template word."""
    vocabulary = frozenset(word for t in templates for word in t.text.encode().split())

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                counts.update(vocabulary.intersection(license_words(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *map(bytes.decode, counts)], pa.string()), pa.array([rows, *counts.values()], pa.int64())],
            names=["word", "n"],
        )

    found = docs.select("text").mapInArrow(of_batches, "word string, n bigint")
    sums = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(None, 0), {word.encode(): n for word, n in sums.items()}


SCANNED = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


def scanned(docs: DataFrame, templates=TEMPLATES, settings: Settings | None = None) -> DataFrame:
    """One row per row of ``docs``: word and place counts, labels and score.

    ``score`` is the best share of a verified template's words that stand in place, 1 if a base
    phrase stands in the text, 0 without any.  A NULL, empty or wordless text has no words, no
    labels (the empty string) and score 0.  Repeated rows get equal results.
    """
    settings = settings or Settings()
    documents, frequency = template_frequency(docs, templates)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, documents, frequency)
        pattern = _base_pattern(BASE_PHRASES)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = license_words(text.as_py())
                base = base_places(words, pattern)
                base_labels = sorted({BASE_PHRASES[phrase] for _, phrase in base})
                found = index.matches(words, settings)
                places = [place for place, _ in base]
                rows.append(
                    (
                        doc_id,
                        len(words),
                        len(base),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(base_labels),
                        ",".join(sorted({*base_labels, *found})),
                        1.0 if base else max(found.values(), default=0.0),
                    )
                )
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                names=[part.split()[0] for part in SCANNED.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(of_batches, SCANNED)
