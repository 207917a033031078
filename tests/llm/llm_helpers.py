"""Plain versions of the operators, row by row, to hold the Spark ones against."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import xxhash

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, lang="en"):
    """Texts, or (doc_id, text), as a table of documents."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOCUMENT)


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_fingerprint(text):
    words = SPACE_WORDS.findall(lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fingerprint); the smallest doc_id reachable, by position."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least.get(root(i)) for i in range(len(rows))]


def plain_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = SPACE_WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if SPACE_WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def crc(value):
    return zlib.crc32(str(value).encode())
