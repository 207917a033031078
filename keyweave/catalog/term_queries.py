"""Terminology mining.

Web pages: one file per host, language as version, address as key; terms are the address
itself and the texts of titles, list items and bold spans.
Brands: one file per part type, part name as key; the brand ``Brand#13`` has the body ``Brand``
and the suffix ``#13``, so one body term holds every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.catalog.base import Query, sql_blank, sql_strip, table
from keyweave.functions.text import SPACE_CLASS
from keyweave.operators import terms as T
from keyweave.operators.candidates import candidates, compound_split, version_counts, with_candidate_ids
from keyweave.operators.lists import ITEMS_PER_CELL
from keyweave.plans.mine_terms import SUMMARY, MergedTerms, mine_terms
from keyweave.plans.term_config import CompoundSplitRule, Normalization, RecordRule, TagSpanRule, TermConfig, Thresholds
from keyweave.session import materialize

# --- web pages ------------------------------------------------------------------------

_HOST, _LANGUAGE = r"^https?://([^/]+)/", r"^https?://[^/]+/([a-z][a-z])/"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.regexp_extract("url", _HOST, 1).alias("path"),
        F.col("page_id").alias("row"),
        F.regexp_extract("url", _LANGUAGE, 1).alias("Version"),
        F.col("url").alias("Key"),
        "url",
        "html",
    )


TOKENS = ("EXAMPLE.com", "spam")
PATTERNS = (r"/(en|DE)/\d+", r"^https://m\.")
TAGS = ("title", "li", "b")
SPANS = TagSpanRule("spans", ("html",), tuple(f"<{t}>" for t in TAGS), tuple(f"</{t}>" for t in TAGS))
BY_TOKEN = RecordRule("by_token", "url", TOKENS)
BY_PATTERN = RecordRule("by_pattern", "url", PATTERNS, key_regex=True)
PAGE_CONFIG = TermConfig(
    rules=(BY_TOKEN, SPANS),
    normalization=Normalization(punctuation={"&amp;": "&", "%%%": "%"}, min_term_length=3),
    thresholds=Thresholds(review_short_len_le=4, review_noise_ratio_ge=0.35),
)
PAGE_PLACE = {"path": "path", "row": "row"}

# --- brands ---------------------------------------------------------------------------


def brands(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_type").alias("path"),
        F.col("p_partkey").alias("row"),
        F.lit("1").alias("version"),
        F.col("p_name").alias("key"),
        F.col("p_brand").alias("brand"),
    )


BRAND_CONFIG = TermConfig(
    rules=(RecordRule("brand", "brand", (".",), key_regex=True),), affix_delimiters=("·", "#")
)

# --- the same in SQL ------------------------------------------------------------------

_PAGE_CELLS = f"""cells AS (
  SELECT regexp_extract(url, '{_HOST}', 1) AS path, page_id AS row,
         regexp_extract(url, '{_LANGUAGE}', 1) AS version, url AS key, url, html FROM pages
)"""
_BRAND_CELLS = """cells AS (
  SELECT p_type AS path, p_partkey AS row, '1' AS version, p_name AS key, p_brand AS brand FROM part
)"""
_SPAN = f"(?s)({'|'.join(f'<{t}>' for t in ('title', 'li', 'b'))})(.*?)({'|'.join(f'</{t}>' for t in ('title', 'li', 'b'))})"
_HAS_TOKEN = " OR ".join(f"contains(lower(key), '{t.lower()}')" for t in TOKENS)
_HAS_PATTERN = " OR ".join(f"regexp_matches(key, '{p}', 'i')" for p in PATTERNS)

_PLACES = "path, path AS file, '' AS sheet, row"


def _record_sql(rule_nr: int, rule_id: str, column: str, col: int, where: str) -> str:
    return f"""SELECT {_PLACES}, {rule_nr} AS rule_nr, 0 AS match_nr, 'record_rule' AS extractor_type,
         '{rule_id}' AS rule_id, {col} AS col, {column} AS term_raw, {column} AS cell_raw,
         key AS key_value, version AS version_value
  FROM cells WHERE ({where}) AND NOT {sql_blank(column)}"""


_SPAN_SQL = f"""SELECT {_PLACES}, 1 AS rule_nr, match_nr, 'tag_span' AS extractor_type, 'spans' AS rule_id,
         4 AS col, regexp_extract(span, '{_SPAN}', 2) AS term_raw, html AS cell_raw,
         key AS key_value, version AS version_value
  FROM (SELECT *, unnest(regexp_extract_all(html, '{_SPAN}', 0)) AS span,
               generate_subscripts(regexp_extract_all(html, '{_SPAN}', 0), 1) AS match_nr FROM cells)
  WHERE NOT {sql_blank(f"regexp_extract(span, '{_SPAN}', 2)")}"""

_PAGE_FOUND = f"""{_PAGE_CELLS}, found AS (
  {_record_sql(0, "by_token", "url", 3, _HAS_TOKEN)}
  UNION ALL {_SPAN_SQL}
)"""
_BRAND_FOUND = f"{_BRAND_CELLS}, found AS ({_record_sql(0, 'brand', 'brand', 3, 'TRUE')})"

_PLACE = "row(path, row, rule_nr, match_nr)"


def _normal_sql(text: str, settings: Normalization) -> str:
    text = f"regexp_replace({sql_strip(text)}, '[{SPACE_CLASS}]+', ' ', 'g')"
    for old, new in settings.punctuation.items():
        text = f"replace({text}, '{old}', '{new}')"
    return text


def _mine_sql(found: str, config: TermConfig, items: int) -> str:
    """The steps from candidates to relations as one chain of common table expressions."""
    d0, d1 = config.affix_delimiters
    settings = config.normalization
    least = settings.min_term_length

    def pieces(*lists: str) -> str:
        """The numbers of the pieces that the longest list is cut into."""
        longest = ", ".join(f"len({name})" for name in lists)
        return f"unnest(range(0, greatest(1, CAST(ceil(greatest({longest}) / {items}) AS BIGINT)))) AS p(items_part)"

    def piece(of: str) -> str:
        cut = f"{of}[items_part * {items} + 1:(items_part + 1) * {items}]"
        return f"coalesce(array_to_string({cut}, ';'), '')"

    noise = "length(regexp_replace(term_norm, '[\\p{L}\\p{N}]+', '', 'g')) / length(term_norm)"
    heavy = f"regexp_full_match({sql_strip('term_norm')}, '([0-9_]|[^\\p{{L}}\\p{{N}}])+')"
    return f"""
WITH {found}, cand AS (
  SELECT *, row_number() OVER (ORDER BY path, row, rule_nr, match_nr) AS seq FROM found
), placed AS (
  SELECT *, least(nullif(instr(term_raw, '{d0}'), 0), nullif(instr(term_raw, '{d1}'), 0)) AS pos FROM cand
), cut AS (
  SELECT *, CASE WHEN substr(term_raw, pos, {len(d0)}) = '{d0}' THEN '{d0}' ELSE '{d1}' END AS delimiter
  FROM placed
), halved AS (
  SELECT *, {sql_strip("substr(term_raw, 1, pos - 1)")} AS body0,
         substr(term_raw, pos + length(delimiter)) AS payload
  FROM cut
), split AS (
  SELECT *, pos IS NOT NULL AND body0 <> '' AND NOT {sql_blank("payload")} AS is_split,
         delimiter || payload AS suffix0
  FROM halved
), long_enough AS (
  SELECT * FROM split WHERE length({_normal_sql("term_raw", settings)}) >= {least}
), comp0 AS (
  SELECT *, 'body' AS term_type, CASE WHEN is_split THEN body0 ELSE term_raw END AS display FROM long_enough
  UNION ALL SELECT *, 'suffix' AS term_type, suffix0 AS display FROM long_enough WHERE is_split
), comp AS (
  SELECT *, lower({_normal_sql("display", settings)}) AS dedup_key FROM comp0
  WHERE length({_normal_sql("display", settings)}) >= {least}
), grouped AS (
  SELECT term_type, dedup_key, arg_min(display, seq) AS term_norm, count(*) AS occurrences_count,
         count(DISTINCT file) AS files_count, arg_min(extractor_type, seq) AS first_extractor,
         arg_min(file, seq) AS sample_file, arg_min(row, seq) AS sample_row, arg_min(col, seq) AS sample_col,
         list(DISTINCT file ORDER BY file) AS files,
         count(DISTINCT nullif(key_value, '')) AS keys_count,
         coalesce(list(DISTINCT key_value ORDER BY key_value) FILTER (WHERE key_value <> ''), []) AS keys
  FROM comp GROUP BY 1, 2
), judged AS (
  SELECT *, list_filter([
           CASE WHEN length(term_norm) <= {config.thresholds.review_short_len_le} THEN 'too_short' END,
           CASE WHEN {heavy} THEN 'symbol_or_number_heavy' END,
           CASE WHEN length(term_norm) > 0 AND {noise} >= {config.thresholds.review_noise_ratio_ge}
                THEN 'high_noise_ratio' END], lambda x: x IS NOT NULL) AS reasons
  FROM grouped
), terms AS (
  SELECT printf('T%06d', row_number() OVER (ORDER BY term_type, dedup_key)) AS term_id, *,
         len(reasons) > 0 AS is_low_confidence, coalesce(array_to_string(reasons, ';'), '') AS review_reasons
  FROM judged
), forms AS (
  SELECT lower({_normal_sql("body0", settings)}) AS body_key, lower({_normal_sql("suffix0", settings)}) AS suffix_key,
         delimiter
  FROM split WHERE is_split AND {_normal_sql("body0", settings)} <> '' AND {_normal_sql("suffix0", settings)} <> ''
), pairs AS (
  SELECT b.term_norm AS body, s.term_norm AS suffix, delimiter
  FROM forms JOIN terms b ON b.term_type = 'body' AND b.dedup_key = body_key
  JOIN terms s ON s.term_type = 'suffix' AND s.dedup_key = suffix_key
), groups AS (
  SELECT 'prefix_anchor' AS role, body AS anchor, count(*) AS n, count(DISTINCT suffix) AS m,
         list(DISTINCT suffix ORDER BY suffix) AS related,
         string_agg(DISTINCT delimiter, ';' ORDER BY delimiter) AS delimiters
  FROM pairs GROUP BY body
  UNION ALL
  SELECT 'suffix_anchor', suffix, count(*), count(DISTINCT body),
         list(DISTINCT body ORDER BY body), string_agg(DISTINCT delimiter, ';' ORDER BY delimiter)
  FROM pairs GROUP BY suffix
), cross_rows AS (
  SELECT 'cross_file' AS relation_type, occurrences_count AS evidence_count, term_norm AS cross_term,
         files_count AS cross_files_count, {piece("files")} AS cross_files_list, '' AS affix_role,
         '' AS affix_anchor_term, CAST(0 AS BIGINT) AS affix_related_count, '' AS affix_related_list,
         '' AS affix_delimiters, '' AS notes, items_part
  FROM terms, {pieces("files")} WHERE files_count >= 2
), group_rows AS (
  SELECT 'affix_group' AS relation_type, n AS evidence_count, '' AS cross_term,
         CAST(0 AS BIGINT) AS cross_files_count, '' AS cross_files_list, role AS affix_role,
         anchor AS affix_anchor_term, m AS affix_related_count, {piece("related")} AS affix_related_list,
         delimiters AS affix_delimiters, '' AS notes, items_part
  FROM groups, {pieces("related")}
), summary_rows AS (
  SELECT term_id, term_type, term_norm, occurrences_count, files_count, {piece("files")} AS files_list, keys_count,
         {piece("keys")} AS keys_list, first_extractor, is_low_confidence, review_reasons, items_part
  FROM terms, {pieces("files", "keys")}
), review AS (
  SELECT term_id, term_norm, unnest(reasons) AS reason, 'medium' AS severity, occurrences_count,
         sample_file, sample_row, sample_col
  FROM terms
), details AS (
  SELECT t.term_id, term_type, t.term_norm, printf('C%08d', seq) AS candidate_id, c.extractor_type, rule_id,
         file, sheet, row, col, key_value, version_value, term_raw, cell_raw
  FROM comp c JOIN terms t USING (term_type, dedup_key)
)"""


_TERM_ROWS = ", ".join(T.TERM_COLUMNS)
_RUN_SUMMARY = """
SELECT CAST((SELECT count(DISTINCT path) FROM cells) AS BIGINT) AS files_total,
       CAST((SELECT count(DISTINCT path) FROM cells) AS BIGINT) AS files_succeeded,
       CAST(0 AS BIGINT) AS files_failed,
       (SELECT count(*) FROM cells) AS rows_scanned, CAST(0 AS BIGINT) AS rows_skipped_by_version,
       (SELECT count(*) FROM found) AS candidates_count, (SELECT count(*) FROM long_enough) AS normalized_count,
       (SELECT count(*) FROM terms WHERE term_type = 'body') AS body_terms_count,
       (SELECT count(*) FROM terms WHERE term_type = 'suffix') AS suffix_terms_count,
       (SELECT count(*) FROM terms) AS terms_count,
       (SELECT count(*) FROM cross_rows WHERE items_part = 0)
         + (SELECT count(*) FROM group_rows WHERE items_part = 0) AS relations_count,
       (SELECT count(*) FROM review) AS review_count"""


@dataclass(frozen=True)
class Binding:
    cells: Callable[[SparkSession, str], DataFrame]
    config: TermConfig
    sql: str
    items_per_cell: int

    def found(self, spark: SparkSession, folder: str) -> DataFrame:
        return candidates(self.cells(spark, folder), self.config.rules, **PAGE_PLACE)

    def parts(self, spark: SparkSession, folder: str) -> DataFrame:
        return T.components(self.found(spark, folder), self.config)

    def terms(self, spark: SparkSession, folder: str) -> DataFrame:
        return T.terms(T.term_state(self.parts(spark, folder)), self.config.thresholds)

    def mined(self, spark: SparkSession, folder: str):
        return mine_terms(
            self.cells(spark, folder), self.config, items_per_cell=self.items_per_cell, **PAGE_PLACE
        )


# The brands have cells so small that most lists go on in further pieces.
PAGES = Binding(pages, PAGE_CONFIG, _mine_sql(_PAGE_FOUND, PAGE_CONFIG, ITEMS_PER_CELL), ITEMS_PER_CELL)
BRANDS = Binding(brands, BRAND_CONFIG, _mine_sql(_BRAND_FOUND, BRAND_CONFIG, 20), 20)


def _records(rule: RecordRule):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = candidates(pages(spark, folder), [rule], **PAGE_PLACE)
        return rows.select("file", "row", "col", "rule_id", "term_raw", "key_value", "version_value")

    return run


def _records_sql(rule: RecordRule, where: str) -> str:
    return f"""WITH {_PAGE_CELLS}, found AS ({_record_sql(0, rule.id, "url", 3, where)})
SELECT file, row, col, rule_id, term_raw, key_value, version_value FROM found"""


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    found = materialize(candidates(pages(spark, folder), [SPANS], **PAGE_PLACE), "spans")
    rows = with_candidate_ids(found)
    return rows.select("candidate_id", "file", "row", "term_raw", "open_tag", "close_tag")


_SPANS_SQL = f"""WITH {_PAGE_CELLS}, spans AS (
  SELECT path, row, unnest(regexp_extract_all(html, '{_SPAN}', 0)) AS span,
         generate_subscripts(regexp_extract_all(html, '{_SPAN}', 0), 1) AS match_nr FROM cells
), parts AS (
  SELECT *, regexp_extract(span, '{_SPAN}', 2) AS term_raw FROM spans
)
SELECT printf('C%08d', row_number() OVER (ORDER BY path, row, match_nr)) AS candidate_id, path AS file, row,
       term_raw, regexp_extract(span, '{_SPAN}', 1) AS open_tag, regexp_extract(span, '{_SPAN}', 3) AS close_tag
FROM parts WHERE NOT {sql_blank("term_raw")}"""


def _compounds(spark: SparkSession, folder: str) -> DataFrame:
    rule = CompoundSplitRule("compound", ("brand",), delimiter="#")
    rows = compound_split(brands(spark, folder), rule, **PAGE_PLACE)
    return rows.drop("path", "sheet")


_COMPOUND_SQL = f"""WITH {_BRAND_CELLS}, halves AS (
  SELECT path, row, key, version, brand, {sql_strip("split_part(brand, '#', 1)")} AS head,
         {sql_strip("substr(brand, instr(brand, '#') + 1)")} AS suffix
  FROM cells WHERE contains(brand, '#')
)
SELECT 'compound_split' AS extractor_type, 'compound' AS rule_id, path AS file, row, 3 AS col, role AS split_role,
       term AS term_raw, brand AS cell_raw, 'brand' AS column_name, '#' AS delimiter, head, suffix,
       head || '#' || suffix AS compound, {sql_strip("key")} AS key_value, version AS version_value FROM (
  SELECT *, 'compound' AS role, head || '#' || suffix AS term FROM halves WHERE head <> '' AND suffix <> ''
  UNION ALL SELECT *, 'head', head FROM halves WHERE head <> '' AND suffix <> ''
  UNION ALL SELECT *, 'suffix', suffix FROM halves WHERE head <> '' AND suffix <> '')"""


_COMPONENT_ROWS = "file, row, rule_id, term_raw, term_type, dedup_key"


def _components(binding: Binding):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = binding.parts(spark, folder).withColumnRenamed("display_term", "display")
        return rows.select("display", *(c.strip() for c in _COMPONENT_ROWS.split(",")))

    return run


def _compound_only(spark: SparkSession, folder: str) -> DataFrame:
    """A configuration whose only rule gives no candidates of its own."""
    config = TermConfig(rules=(CompoundSplitRule("compound", ("brand",), delimiter="#"),))
    return mine_terms(brands(spark, folder), config, **PAGE_PLACE).summary


_COMPOUND_ONLY_SQL = f"""WITH {_BRAND_CELLS}
SELECT count(DISTINCT path) AS files_total, count(DISTINCT path) AS files_succeeded, count(*) AS rows_scanned,
       {", ".join(f"CAST(0 AS BIGINT) AS {name}" for name in SUMMARY
                  if name not in ("files_total", "files_succeeded", "rows_scanned"))}
FROM cells"""


@dataclass(frozen=True)
class LinkWords:
    """An extractor of the catalogue's own: the words of the path of an address, from the second one on."""

    id: str = "link_words"
    extractor_type: str = "link_word"
    source_columns: tuple[str, ...] = ("url",)
    enabled: bool = True

    def required_columns(self) -> set[str]:
        return set(self.source_columns)

    def texts(self, column: str, text) -> Column:
        return F.slice(F.split(F.regexp_replace(text(column), "^[a-z]+://[^/]+/", ""), "[/?=&]"), 2, 1000)


def _own_extractor(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of the configuration and words of addresses, found in one pass."""
    config = TermConfig(rules=(SPANS, LinkWords()))
    return mine_terms(pages(spark, folder), config, **PAGE_PLACE).terms.select(*_OWN_TERMS)


_OWN_TERMS = ("term_type", "dedup_key", "occurrences_count", "files_count", "first_extractor")
_OWN_FOUND = f"""{_PAGE_CELLS}, found AS (
  {_SPAN_SQL.replace("1 AS rule_nr", "0 AS rule_nr")}
  UNION ALL SELECT {_PLACES}, 1 AS rule_nr, match_nr, 'link_word', 'link_words', 3 AS col, term_raw, url, key, version
  FROM (SELECT *, unnest(words) AS term_raw, generate_subscripts(words, 1) AS match_nr
        FROM (SELECT *, string_split_regex(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[/?=&]')[2:] AS words FROM cells))
  WHERE NOT {sql_blank("term_raw")}
)"""


def _merged(binding: Binding, spark: SparkSession, folder: str) -> MergedTerms:
    """The files in two halves, mined apart; the states meet."""
    cells = binding.cells(spark, folder)
    odd = F.crc32(F.col("path").cast("binary")) % 2 == 1
    runs = [
        mine_terms(half, binding.config, items_per_cell=binding.items_per_cell, **PAGE_PLACE)
        for half in (cells.where(odd), cells.where(~odd))
    ]
    return MergedTerms(
        [r.state for r in runs], [r.term_keys for r in runs], binding.config, items_per_cell=binding.items_per_cell
    )


QUERIES = {
    "terms_own_extractor": Query(
        _own_extractor,
        f"{_mine_sql(_OWN_FOUND, TermConfig(rules=()), ITEMS_PER_CELL)} SELECT {', '.join(_OWN_TERMS)} FROM terms",
    ),
    "terms_merged": Query(
        lambda s, d: _merged(PAGES, s, d).terms.select(*T.TERM_COLUMNS), f"{PAGES.sql} SELECT {_TERM_ROWS} FROM terms"
    ),
    "terms_summary_merged": Query(
        lambda s, d: _merged(BRANDS, s, d).terms_summary, f"{BRANDS.sql} SELECT * FROM summary_rows"
    ),
    "terms_compound_only": Query(_compound_only, _COMPOUND_ONLY_SQL),
    "record_rule_contains": Query(_records(BY_TOKEN), _records_sql(BY_TOKEN, _HAS_TOKEN)),
    "record_rule_regex": Query(_records(BY_PATTERN), _records_sql(BY_PATTERN, _HAS_PATTERN)),
    "tag_span_candidates": Query(_spans, _SPANS_SQL),
    "compound_split": Query(_compounds, _COMPOUND_SQL),
    "version_filter_counts": Query(
        lambda s, d: version_counts(pages(s, d), ("en", "de"), "Version"),
        f"""WITH {_PAGE_CELLS}
SELECT count(*) AS rows_scanned,
       count(*) FILTER (WHERE version NOT IN ('en', 'de')) AS rows_skipped_by_version FROM cells""",
    ),
    "term_components_pages": Query(_components(PAGES), f"{PAGES.sql} SELECT display, {_COMPONENT_ROWS} FROM comp"),
    "term_components_brands": Query(
        _components(BRANDS), f"{BRANDS.sql} SELECT display, {_COMPONENT_ROWS} FROM comp"
    ),
    "terms_pages": Query(
        lambda s, d: PAGES.terms(s, d).select(*T.TERM_COLUMNS), f"{PAGES.sql} SELECT {_TERM_ROWS} FROM terms"
    ),
    "terms_brands": Query(
        lambda s, d: BRANDS.terms(s, d).select(*T.TERM_COLUMNS), f"{BRANDS.sql} SELECT {_TERM_ROWS} FROM terms"
    ),
    "terms_summary_pages": Query(lambda s, d: PAGES.mined(s, d).terms_summary, f"{PAGES.sql} SELECT * FROM summary_rows"),
    "terms_summary_brands": Query(lambda s, d: BRANDS.mined(s, d).terms_summary, f"{BRANDS.sql} SELECT * FROM summary_rows"),
    "cross_file_terms": Query(lambda s, d: BRANDS.mined(s, d).cross_file_terms, f"{BRANDS.sql} SELECT * FROM cross_rows"),
    "affix_groups": Query(lambda s, d: BRANDS.mined(s, d).affix_groups, f"{BRANDS.sql} SELECT * FROM group_rows"),
    "relations_summary_pages": Query(
        lambda s, d: PAGES.mined(s, d).relations_summary,
        f"{PAGES.sql} SELECT * FROM cross_rows UNION ALL SELECT * FROM group_rows",
    ),
    "relations_summary_brands": Query(
        lambda s, d: BRANDS.mined(s, d).relations_summary,
        f"{BRANDS.sql} SELECT * FROM cross_rows UNION ALL SELECT * FROM group_rows",
    ),
    "term_files": Query(
        lambda s, d: PAGES.mined(s, d).term_files, f"{PAGES.sql} SELECT DISTINCT term_type, dedup_key, file FROM comp"
    ),
    "term_keys": Query(
        lambda s, d: PAGES.mined(s, d).term_keys,
        f"{PAGES.sql} SELECT DISTINCT term_type, dedup_key, key_value FROM comp WHERE key_value <> ''",
    ),
    "related_terms": Query(
        lambda s, d: BRANDS.mined(s, d).related_terms.drop("anchor_key"),
        f"""{BRANDS.sql} SELECT DISTINCT 'prefix_anchor' AS role, body AS anchor_term, suffix AS related_term FROM pairs
UNION SELECT 'suffix_anchor', suffix, body FROM pairs""",
    ),
    "review_items_pages": Query(
        lambda s, d: T.review_items(PAGES.terms(s, d)), f"{PAGES.sql} SELECT * FROM review"
    ),
    "review_items_brands": Query(
        lambda s, d: T.review_items(BRANDS.terms(s, d)), f"{BRANDS.sql} SELECT * FROM review"
    ),
    "term_details": Query(lambda s, d: PAGES.mined(s, d).details, f"{PAGES.sql} SELECT * FROM details"),
    "term_run_summary": Query(lambda s, d: PAGES.mined(s, d).summary, f"{PAGES.sql} {_RUN_SUMMARY}"),
}
