"""Term candidates: texts taken from the cells of the rows of many files.

All rules are applied in one pass over the table: each row yields, per rule and column, an
array of found texts, and the arrays are expanded afterwards.

Besides the rules of the configuration, any object that is an ``Extractor`` may be given as a rule: it says which
columns it reads and gives an array of texts for each, and goes into the same pass.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.text import is_blank, key_matches, strip
from keyweave.operators.joins import inner_join_unique
from keyweave.operators.rows import text_of
from keyweave.operators.sequence import numbered
from keyweave.plans.term_config import CompoundSplitRule, RecordRule, TagSpanRule

# The place of a candidate: file, row, rule, column of the rule, match within the cell.
CANDIDATE_ORDER = ["path", "row", "rule_nr", "column_nr", "match_nr"]


_CANDIDATES = (
    "path string, file string, sheet string, row bigint, rule_nr int, column_nr int, match_nr int, "
    "extractor_type string, rule_id string, col int, term_raw string, column_name string, open_tag string, "
    "close_tag string, key_value string, version_value string"
)


@runtime_checkable
class Extractor(Protocol):
    """A rule from outside.  ``texts`` gives the array of texts that a row has for one of its ``source_columns``.

    Its argument ``text`` gives the text of a column by its header name, empty cells as the empty text.
    """

    id: str
    extractor_type: str
    source_columns: Sequence[str]
    enabled: bool

    def required_columns(self) -> set[str]: ...

    def texts(self, column: str, text: Callable[[str], Column]) -> Column: ...


def header_map(headers: Sequence[str | None]) -> dict[str, int]:
    """0-based column of every header name, and of its lower-case form where that is free.

    Blank headers are called ``col_<position>``.  A header whose name is in use, be it as the
    lower-case form of another one, gets ``_1``, ``_2``, ... appended, counted over the table.
    """
    suffixes = itertools.count(1)
    found: dict[str, int] = {}

    def free(name: str) -> str:
        return f"{name}_{next(suffixes)}" if name in found else name

    names = (strip_header(h) or f"col_{nr}" for nr, h in enumerate(headers, start=1))
    for column, name in enumerate(names):
        unique = free(name)
        found |= {unique: column} if unique.lower() in found else {unique.lower(): column, unique: column}
    return found


def strip_header(header: str | None) -> str:
    return "" if header is None else header.strip()


def missing_columns(headers: Mapping[str, int], required: set[str]) -> list[str]:
    return sorted(name for name in required if name not in headers)


def of_versions(cells: DataFrame, versions: Sequence[str], version: str = "version") -> DataFrame:
    """Rows whose stripped version is one of the given ones; no versions means all rows."""
    if not versions:
        return cells
    return cells.filter(strip(text_of(cells, version)).isin(*versions))


def version_counts(cells: DataFrame, versions: Sequence[str], version: str = "version") -> DataFrame:
    """Rows scanned, and rows skipped because of their version."""
    skipped = F.lit(0)
    if versions:
        skipped = (~strip(text_of(cells, version)).isin(*versions)).cast("bigint")
    return cells.agg(
        F.count(F.lit(1)).alias("rows_scanned"),
        F.coalesce(F.sum(skipped), F.lit(0)).cast("bigint").alias("rows_skipped_by_version"),
    )


def tag_pattern(tags: Sequence[str]) -> str:
    """Any of the tags, the longer ones first where one is the beginning of another."""
    return "|".join(re.escape(t) for t in sorted({t for t in tags if t}, key=lambda t: (-len(t), t)))


def _span_pattern(rule: TagSpanRule) -> str:
    return f"(?s)({tag_pattern(rule.open_tags)})(.*?)({tag_pattern(rule.close_tags)})"


class _Cells:
    """Columns of a cell table by header name."""

    def __init__(self, cells: DataFrame, service: Sequence[str]):
        names = [c for c in cells.columns if c not in service]
        self.headers = header_map(names)
        self._names = names
        self._cells = cells

    def place(self, header: str) -> int:
        return self.headers[header]

    def name(self, header: str) -> str:
        return self._names[self.headers[header]]

    def text(self, header: str) -> Column:
        return text_of(self._cells, self.name(header))

    def optional(self, header: str) -> Column:
        return strip(self.text(header)) if header in self.headers else F.lit("")


def candidates(
    cells: DataFrame,
    rules: Sequence[RecordRule | TagSpanRule | CompoundSplitRule | Extractor],
    *,
    path: str,
    row: str,
    file: str | None = None,
    sheet: str | None = None,
    versions: Sequence[str] = (),
) -> DataFrame:
    """The candidates of all enabled record rules, tag spans and own extractors.

    ``path`` orders the files, ``file`` is the name shown for one (the path if not given);
    path and row together name one row.  Compound rules are no part of the extraction.
    The text of the whole cell is not repeated per candidate; see ``with_cell_text``.
    """
    service = [c for c in dict.fromkeys([path, row, file, sheet]) if c]
    rules = [r for r in rules if not isinstance(r, CompoundSplitRule)]
    table = _Cells(cells, service)
    required = set().union(*(r.required_columns() for r in rules)) | ({"version"} if versions else set())
    if missing := missing_columns(table.headers, required):
        raise ValueError(f"columns not found: {', '.join(missing)}")

    found, uses = [], []
    for rule_nr, rule in enumerate(rules):
        if not rule.enabled:
            continue
        if isinstance(rule, RecordRule):
            hit = key_matches(table.text("key"), rule.key_terms, regex=rule.key_regex)
            columns = [(rule.term_column, F.when(hit, F.array(table.text(rule.term_column))))]
        elif isinstance(rule, TagSpanRule):
            pattern = F.lit(_span_pattern(rule))
            columns = [(c, F.regexp_extract_all(table.text(c), pattern, F.lit(0))) for c in rule.source_columns]
        else:
            columns = [(c, rule.texts(c, table.text)) for c in rule.source_columns]
        for column_nr, (name, texts) in enumerate(columns):
            uses.append((rule_nr, column_nr, rule, name))
            found.append(
                F.struct(
                    F.lit(rule_nr).alias("rule_nr"),
                    F.lit(column_nr).alias("column_nr"),
                    F.lit(len(uses) - 1).alias("use"),
                    texts.alias("texts"),
                )
            )
    if not found:  # no rule is switched on, or compounds only: a table without rows
        return cells.sparkSession.createDataFrame([], _CANDIDATES)

    places = (
        F.col(path).cast("string").alias("path"),
        (F.col(file) if file else F.col(path)).cast("string").alias("file"),
        (F.col(sheet).cast("string") if sheet else F.lit("")).alias("sheet"),
        F.col(row).cast("bigint").alias("row"),
        table.optional("key").alias("key_value"),
        table.optional("version").alias("version_value"),
    )
    expanded = (
        of_versions(cells, versions, table.name("version") if versions else "")
        .select(*places, F.explode(F.array(*found)).alias("_found"))
        .select(
            *("*", "_found.rule_nr", "_found.column_nr", "_found.use"),
            F.posexplode("_found.texts").alias("match_nr", "_span"),
        )
    )

    def by_use(value) -> Column:
        chosen = F.lit(None).cast("string")
        for nr, use in reversed(list(enumerate(uses))):
            chosen = F.when(F.col("use") == nr, value(*use[2:])).otherwise(chosen)
        return chosen

    def part(group: int) -> Column:
        def pick(rule, _name):
            if isinstance(rule, TagSpanRule):
                return F.regexp_extract("_span", _span_pattern(rule), group)
            return F.col("_span") if group == 2 else F.lit(None).cast("string")

        return by_use(pick)

    return expanded.select(
        *("path", "file", "sheet", "row", "rule_nr", "column_nr", "match_nr"),
        by_use(lambda r, _n: F.lit(_type_of(r))).alias("extractor_type"),
        by_use(lambda r, _n: F.lit(r.id)).alias("rule_id"),
        by_use(lambda _r, n: F.lit(table.place(n) + 1)).cast("int").alias("col"),
        part(2).alias("term_raw"),
        by_use(lambda _r, n: F.lit(n)).alias("column_name"),
        part(1).alias("open_tag"),
        part(3).alias("close_tag"),
        "key_value",
        "version_value",
    ).filter(~is_blank(F.col("term_raw")))


def _type_of(rule: RecordRule | TagSpanRule | Extractor) -> str:
    if isinstance(rule, RecordRule):
        return "record_rule"
    return "tag_span" if isinstance(rule, TagSpanRule) else rule.extractor_type


def with_cell_text(
    found: DataFrame,
    cells: DataFrame,
    rules: Sequence[RecordRule | TagSpanRule | CompoundSplitRule | Extractor],
    *,
    path: str,
    row: str,
    file: str | None = None,
    sheet: str | None = None,
) -> DataFrame:
    """``found`` with ``cell_raw``, the text of the cell each candidate was taken from.

    Every row of the cell table is shuffled once, however many candidates it holds.
    """
    table = _Cells(cells, [c for c in dict.fromkeys([path, row, file, sheet]) if c])
    used = [r for r in rules if r.enabled and not isinstance(r, CompoundSplitRule)]
    names = dict.fromkeys(
        n for r in used for n in ([r.term_column] if isinstance(r, RecordRule) else r.source_columns)
    )
    raws = {name: f"_cell_{i}" for i, name in enumerate(names)}
    texts = cells.select(
        F.col(path).cast("string").alias("path"),
        F.col(row).cast("bigint").alias("row"),
        *(table.text(name).alias(raw) for name, raw in raws.items()),
    )
    chosen = F.lit(None).cast("string")
    for name, raw in raws.items():
        chosen = F.when(F.col("column_name") == name, F.col(raw)).otherwise(chosen)
    joined = inner_join_unique(found, texts, ["path", "row"])
    return joined.withColumn("cell_raw", chosen).drop(*raws.values())


def with_candidate_ids(found: DataFrame) -> DataFrame:
    """Candidates numbered ``C00000001`` ... in the order of their places.

    The sort reads its input twice, so candidates that are costly to find should be stored.
    """
    rows = numbered(found, CANDIDATE_ORDER, "candidate_seq", label="candidates")
    return rows.withColumn("candidate_id", F.format_string("C%08d", "candidate_seq"))


def compound_split(
    cells: DataFrame,
    rule: CompoundSplitRule,
    *,
    path: str,
    row: str,
    file: str | None = None,
    sheet: str | None = None,
) -> DataFrame:
    """Compound, head and suffix of every cell that the delimiter splits in two texts.

    A row per part, named by ``split_role``, with the rule, the key and version of the row, and all parts of the cell.
    """
    service = [c for c in dict.fromkeys([path, row, file, sheet]) if c]
    table = _Cells(cells, service)
    if missing := missing_columns(table.headers, rule.required_columns()):
        raise ValueError(f"columns not found: {', '.join(missing)}")
    roles = [
        role
        for role, emitted in (
            ("compound", rule.emit_compound),
            ("head", rule.emit_head),
            ("suffix", rule.emit_suffix),
        )
        if emitted and rule.enabled
    ]
    per_column = [
        F.struct(
            F.lit(nr).alias("column_nr"),
            F.lit(name).alias("column_name"),
            F.lit(table.place(name) + 1).alias("col"),
            table.text(name).alias("cell_raw"),
        )
        for nr, name in enumerate(rule.source_columns)
    ]
    parts = cells.select(
        F.col(path).cast("string").alias("path"),
        (F.col(file) if file else F.col(path)).cast("string").alias("file"),
        (F.col(sheet).cast("string") if sheet else F.lit("")).alias("sheet"),
        F.col(row).cast("bigint").alias("row"),
        table.optional("key").alias("key_value"),
        table.optional("version").alias("version_value"),
        F.inline(F.array(*per_column)),
    )
    at = F.instr("cell_raw", rule.delimiter)
    halves = parts.filter(at > 0).select(
        "*",
        strip(F.substring("cell_raw", F.lit(1), at - 1)).alias("head"),
        strip(F.substring("cell_raw", at + len(rule.delimiter), F.length("cell_raw"))).alias("suffix"),
    )
    whole = halves.filter((F.col("head") != "") & (F.col("suffix") != "")).withColumn(
        "compound", F.concat("head", F.lit(rule.delimiter), "suffix")
    )
    every = F.array(
        *(
            F.struct(F.lit(r).alias("split_role"), F.col(r).alias("term_raw"))
            for r in ("compound", "head", "suffix")
        )
    )
    emitted = F.filter(every, lambda e: e["split_role"].isin(roles))
    return whole.select(
        F.lit("compound_split").alias("extractor_type"),
        F.lit(rule.id).alias("rule_id"),
        *("path", "file", "sheet", "row", "col"),
        F.inline(emitted),
        *("cell_raw", "column_name"),
        F.lit(rule.delimiter).alias("delimiter"),
        *("head", "suffix", "compound", "key_value", "version_value"),
    )
