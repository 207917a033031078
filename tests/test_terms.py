"""Terminology mining: a small folder with known results, edge cases, and random cells against a fold."""

import json
import random
import re
from collections import defaultdict

import pytest
from helpers import rows
from pyspark.sql import functions as F

from keyweave.operators.candidates import Extractor, candidates, compound_split, header_map, version_counts
from keyweave.operators.lists import COUNT, LIST, PART, list_cells
from keyweave.operators.relations import RELATION_COLUMNS
from keyweave.operators.sequence import numbered
from keyweave.plans.mine_terms import MergedTerms, mine_terms
from keyweave.plans.term_config import CompoundSplitRule, Normalization, RecordRule, TagSpanRule, TermConfig, term_config

CELLS = "path string, row long, Version string, Key string, source string"
PLACE = {"path": "path", "row": "row"}
CONFIG = {
    "version": 1,
    "versions": "spring, autumn",
    "affix_delimiters": ["~", "=>"],
    "extractors": [
        {"id": "labels", "type": "record_rule", "term_column": "source", "key": "label"},
        {"id": "marks", "type": "tag_span", "source_columns": ["source"], "open_tag": "[[", "close_tags": ["]]", "[/]"]},
    ],
}
SHELVES = [
    ("east", 1, "spring", "label_top", "copper kettle"),
    ("east", 2, "autumn", "note", "use the [[slow flame]] or [[copper kettle[/] first"),
    ("east", 3, "winter", "label_low", "out of season"),
    ("north", 1, "autumn", "label_mid", "copper kettle"),
    ("north", 2, "autumn", "label_mid", "copper kettle~lid"),
    ("north", 3, "spring", "label_low", "tin cup => handle"),
    ("west", 1, "spring", "note", "nothing marked here"),
    ("west", 2, "spring", "LABEL_END", "tin cup~lid"),
    ("west", 3, "autumn", "label_end", "  "),
]


def config(**changes):
    return term_config({**CONFIG, **changes})


def mine(spark, table, settings=None, **options):
    return mine_terms(spark.createDataFrame(table, CELLS), settings or config(), **PLACE, **options)


def test_shelves(spark):
    mined = mine(spark, SHELVES)
    terms = {(r.term_type, r.term_norm): r for r in mined.terms_summary.collect()}
    assert set(terms) == {
        ("body", "copper kettle"), ("body", "slow flame"), ("body", "tin cup"), ("suffix", "~lid"), ("suffix", "=> handle"),
    }
    kettle, lid = terms["body", "copper kettle"], terms["suffix", "~lid"]
    assert (kettle.occurrences_count, kettle.files_count, kettle.files_list) == (4, 2, "east;north")
    assert (kettle.keys_count, kettle.keys_list, kettle.items_part) == (3, "label_mid;label_top;note", 0)
    assert (kettle.first_extractor, kettle.is_low_confidence) == ("record_rule", False)
    assert (lid.occurrences_count, lid.files_list, lid.keys_list) == (2, "north;west", "LABEL_END;label_mid")
    ids = [r.term_id for r in mined.terms.orderBy("term_type", "dedup_key").collect()]
    assert ids == ["T000001", "T000002", "T000003", "T000004", "T000005"]

    relations = mined.relations_summary.collect()
    assert mined.relations_summary.columns == [*RELATION_COLUMNS, PART]
    cross = {(r.cross_term, r.cross_files_list) for r in relations if r.relation_type == "cross_file"}
    assert cross == {("copper kettle", "east;north"), ("tin cup", "north;west"), ("~lid", "north;west")}
    groups = {
        (r.affix_role, r.affix_anchor_term): (r.affix_related_list, r.affix_delimiters, r.evidence_count)
        for r in relations
        if r.affix_role
    }
    assert groups == {
        ("prefix_anchor", "copper kettle"): ("~lid", "~", 1),
        ("prefix_anchor", "tin cup"): ("=> handle;~lid", "=>;~", 2),
        ("suffix_anchor", "~lid"): ("copper kettle;tin cup", "~", 2),
        ("suffix_anchor", "=> handle"): ("tin cup", "=>", 1),
    }

    summary = mined.summary.first().asDict()
    assert (summary["rows_scanned"], summary["rows_skipped_by_version"], summary["files_succeeded"]) == (9, 1, 3)
    assert (summary["candidates_count"], summary["terms_count"]) == (7, 5)
    assert (summary["body_terms_count"], summary["suffix_terms_count"]) == (3, 2)
    assert summary["relations_count"] == len(relations) == 7

    details = mined.details.orderBy("candidate_id", "term_type").collect()
    assert len(details) == 10
    assert [d.candidate_id for d in details[:2]] == ["C00000001", "C00000002"]
    spans = [d for d in details if d.extractor_type == "tag_span"]
    assert [(d.term_raw, d.row, d.col, d.key_value, d.version_value, d.rule_id) for d in spans] == [
        ("slow flame", 2, 3, "note", "autumn", "marks"),
        ("copper kettle", 2, 3, "note", "autumn", "marks"),
    ]
    assert spans[0].cell_raw == SHELVES[1][4]


@pytest.mark.parametrize(
    "text, body, suffix",
    [
        ("Äpfel im Korb => rot und grün", "Äpfel im Korb", "=> rot und grün"),
        ("茶壶~盖子", "茶壶", "~盖子"),
        ("p~q~r", "p", "~q~r"),
    ],
)
def test_affixes(spark, text, body, suffix):
    mined = mine(spark, [("f", 2, "spring", "label", text)])
    found = [(r.affix_role, r.affix_anchor_term, r.affix_related_list) for r in mined.relations_summary.collect()]
    assert found == [("prefix_anchor", body, suffix), ("suffix_anchor", suffix, body)]


def test_first_raw_text_is_shown_and_measured(spark):
    mined = mine(spark, [("f", 2, "spring", "label", "  x  "), ("f", 3, "spring", "label", "X"), ("f", 4, "spring", "label", "##9")])
    shown = {r.dedup_key: (r.term_norm, r.review_reasons) for r in mined.terms.collect()}
    # The raw text is five characters long, so the term is not too short, but four of five are noise.
    assert shown == {"x": ("  x  ", "high_noise_ratio"), "##9": ("##9", "symbol_or_number_heavy;high_noise_ratio")}
    assert [(r.term_norm, r.reason, r.severity, r.sample_row, r.sample_col) for r in mined.review.collect()] == [
        ("##9", "symbol_or_number_heavy", "medium", 4, 3),
        ("##9", "high_noise_ratio", "medium", 4, 3),
        ("  x  ", "high_noise_ratio", "medium", 2, 3),
    ]


def test_minimum_length_applies_to_whole_and_part(spark):
    settings = config(normalization={"min_term_length": 3})
    mined = mine(spark, [("f", 2, "spring", "label", "ab~cde"), ("f", 3, "spring", "label", "xy"), ("f", 4, "spring", "label", "abc~d")], settings)
    assert {(r.term_type, r.term_norm) for r in mined.terms.collect()} == {("suffix", "~cde"), ("body", "abc")}
    # Both halves of a pair must be terms: none of these pairs has both.
    assert mined.relations_summary.count() == 0


def test_tag_spans(spark):
    rule = TagSpanRule("t", ("source",), ("<a>", "<a>>", "<b>"), ("</tag>", "</>"))
    text = "<a>one</tag> <b>two\nlines</> <a>>three</> <a>  </> <a>four <b>five</tag></>"
    table = spark.createDataFrame([("f", 2, "", None, text)], CELLS)
    got = rows(candidates(table, [rule], **PLACE).select("match_nr", "open_tag", "term_raw", "close_tag"), "match_nr")
    pattern = re.compile(r"(<a>>|<a>|<b>)(.*?)(</tag>|</>)", re.DOTALL)
    want = [m.groups() for m in pattern.finditer(text)]
    assert [g[1:] for g in got] == [w for w in want if w[1].strip()]


def test_disabled_rules_still_need_their_columns(spark):
    table = spark.createDataFrame(SHELVES[:1], CELLS)
    rules = [RecordRule("r", "source", ("name",)), TagSpanRule("t", ("nowhere", "also"), enabled=False)]
    with pytest.raises(ValueError, match="columns not found: also, nowhere"):
        candidates(table, rules, **PLACE)


def test_rules_that_give_no_candidates(spark):
    table = spark.createDataFrame(SHELVES, CELLS)
    for rule in (CompoundSplitRule("c", ("source",)), RecordRule("r", "source", ("label",), enabled=False)):
        mined = mine_terms(table, TermConfig((rule,)), **PLACE)
        assert mined.terms_summary.count() == mined.relations_summary.count() == mined.details.count() == 0
        summary = mined.summary.first()
        assert (summary.rows_scanned, summary.candidates_count, summary.terms_count) == (len(SHELVES), 0, 0)


def test_headers():
    assert header_map([" Key ", "", None, "key", "Text", "Text"]) == {
        "Key": 0,
        "key": 0,
        "col_2": 1,
        "col_3": 2,
        "key_1": 3,
        "Text": 4,
        "text": 4,
        "Text_2": 5,
        "text_2": 5,
    }


def test_version_counts(spark):
    table = spark.createDataFrame([("f", 2, " may ", "k", "a"), ("f", 3, "june", "k", "x"), ("f", 4, None, "k", "b"), ("f", 5, "MAY", "k", "b")], CELLS)
    assert rows(version_counts(table, ("may",), "Version")) == [(4, 3)]
    assert rows(version_counts(table, (), "Version")) == [(4, 0)]


def test_compound_split(spark):
    table = spark.createDataFrame([("f", 2, "", "", " a · b·c "), ("f", 3, "", "", "a·"), ("f", 4, "", "", "ab"), ("f", 5, "", "", None)], CELLS)
    got = compound_split(table, CompoundSplitRule("c", ("source",)), **PLACE)
    assert {(r.split_role, r.term_raw, r.col) for r in got.collect()} == {
        ("compound", "a·b·c", 3),
        ("head", "a", 3),
        ("suffix", "b·c", 3),
    }
    heads = compound_split(table, CompoundSplitRule("c", ("source",), emit_compound=False, emit_suffix=False), **PLACE)
    assert [r.split_role for r in heads.collect()] == ["head"]
    off = compound_split(table, CompoundSplitRule("c", ("source",), enabled=False), **PLACE)
    assert off.count() == 0


def test_compounds_carry_their_rule_and_their_row(spark):
    table = spark.createDataFrame([("f", 2, " v1 ", " k ", "a·b")], CELLS)
    got = compound_split(table, CompoundSplitRule("c", ("source",), emit_compound=False, emit_suffix=False), **PLACE).first()
    assert (got.extractor_type, got.rule_id, got.delimiter) == ("compound_split", "c", "·")
    assert (got.head, got.suffix, got.compound, got.key_value, got.version_value) == ("a", "b", "a·b", "k", "v1")


class Words:
    """An extractor from outside: every word of a cell."""

    id, extractor_type, source_columns, enabled = "words", "word", ("source", "Key"), True

    def required_columns(self):
        return set(self.source_columns)

    def texts(self, column, text):
        return F.split(text(column), " ")


def test_own_extractors_share_the_pass_of_the_rules(spark):
    table = spark.createDataFrame([("f", 2, "v", "name", "one two"), ("f", 3, "v", "x", None)], CELLS)
    rules = (RecordRule("r", "source", ("name",)), Words())
    found = candidates(table, rules, **PLACE).orderBy("row", "rule_nr", "column_nr", "match_nr")
    got = [(r.row, r.extractor_type, r.rule_id, r.col, r.term_raw, r.column_name) for r in found.collect()]
    assert got == [
        (2, "record_rule", "r", 3, "one two", "source"),
        (2, "word", "words", 3, "one", "source"),
        (2, "word", "words", 3, "two", "source"),
        (2, "word", "words", 2, "name", "Key"),
        (3, "word", "words", 2, "x", "Key"),
    ]
    assert isinstance(Words(), Extractor) and not isinstance(rules[0], Extractor)
    mined = mine_terms(table, TermConfig(rules), **PLACE)
    assert {(r.term_norm, r.cell_raw) for r in mined.details.collect()} >= {("two", "one two"), ("x", "x")}
    with pytest.raises(ValueError, match="columns not found: Key, source"):
        candidates(table.drop("Key", "source"), (Words(),), **PLACE)


@pytest.mark.parametrize("parts", [1, 3])
def test_states_of_several_runs_give_what_one_run_gives(spark, parts):
    rng = random.Random(parts)
    words = ["a", "B", "b", "a·x", "A·x", "c·y ", "long term", "long  term", "7", ""]
    table = [
        (f"f{rng.randrange(9)}", i, "v", rng.choice(["name", "other name", "x"]), rng.choice(words)) for i in range(200)
    ]
    settings = TermConfig((RecordRule("r", "source", ("name",)),))
    whole = mine_terms(spark.createDataFrame(table, CELLS), settings, items_per_cell=2, **PLACE)
    runs = [
        mine_terms(spark.createDataFrame([r for r in table if int(r[0][1]) % parts == k], CELLS), settings, **PLACE)
        for k in range(parts)
    ]
    merged = MergedTerms([r.state for r in runs], [r.term_keys for r in runs], settings, items_per_cell=2)
    for name in ("terms", "term_files", "term_keys", "terms_summary", "cross_file_terms", "review"):
        got, want = (sorted(map(str, getattr(x, name).collect())) for x in (merged, whole))
        assert got == want and got, name
    again = MergedTerms([merged.state], [merged.term_keys], settings)
    assert sorted(map(str, again.terms.collect())) == sorted(map(str, whole.terms.collect()))


# --- configuration --------------------------------------------------------------------


def test_config_defaults():
    read = term_config(json.dumps({"version": 1, "extractors": [{"type": "tag_span", "id": "t", "source_columns": [" a ", ""]}]}))
    assert read.affix_delimiters == ("·", ":") and read.files == () and read.versions == ()
    assert read.rules == (TagSpanRule("t", ("a",), ("<tag>",), ("</tag>", "</>")),)
    assert term_config({**CONFIG, "files": "*", "versions": ["1", "ALL"]}).versions == ()
    on = {"punctuation_normalization": {"enabled": True, "map": {"，": ","}}}
    assert term_config({**CONFIG, "normalization": on}).normalization.punctuation == {"，": ","}
    assert config().required_columns() == {"source", "key", "version"}


@pytest.mark.parametrize(
    "change, message",
    [
        ({"version": 2}, "version 1 only"),
        ({"compound_delimiters": ["x"]}, "old setting"),
        ({"extractors": []}, "at least one rule"),
        ({"extractors": [{"type": "other", "id": "x"}]}, "no rule type"),
        ({"extractors": [{"type": "record_rule"}]}, "needs an id"),
        ({"extractors": [{"type": "record_rule", "id": "r", "key": "k"}]}, "no term_column"),
        ({"extractors": [{"type": "record_rule", "id": "r", "term_column": "t"}]}, "at least one value"),
        ({"extractors": [{"type": "record_rule", "id": "r", "term_column": "t", "key": " , "}]}, "at least one value"),
        ({"extractors": [{"type": "record_rule", "id": "r", "term_column": "t", "key": "k", "conditions": 1}]}, "old setting"),
        ({"extractors": [{"type": "record_rule", "id": "r", "term_column": "t", "key": "(", "key_regex": True}]}, "is no pattern"),
        ({"extractors": [{"type": "tag_span", "id": "t", "source_columns": []}]}, "list of columns"),
        ({"extractors": [{"type": "compound_split", "id": "c", "source_columns": ["a"], "delimiter": ""}]}, "no delimiter"),
        ({"normalization": {"min_term_length": 0}}, "min_term_length"),
        ({"thresholds": {"review_noise_ratio_ge": 1.5}}, "review_noise_ratio_ge"),
        ({"thresholds": {"containment_min_len": 0}}, "containment_min_len"),
        ({"affix_delimiters": 3}, "give a list"),
    ],
)
def test_config_errors(change, message):
    with pytest.raises(ValueError, match=message):
        term_config({**CONFIG, **change})


# --- numbering and lists --------------------------------------------------------------


def test_numbers_are_consecutive_over_partitions(spark):
    table = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x" * 50).alias("pad"))
    got = rows(numbered(table.repartition(5), ["v"], "nr", start=10), "v")
    assert [r[2] for r in got] == list(range(10, 5010))
    assert numbered(table.limit(0), ["v"], "nr").count() == 0


def test_long_lists_are_whole_in_pieces(spark):
    pairs = [("hot", f"i{i:04d}") for i in range(25)] + [("cold", "b"), ("cold", "a")]
    table = spark.createDataFrame(pairs, "g string, item string").repartition(4)
    one = {r.g: r for r in list_cells(table, ["g"], "item").collect()}
    assert one["cold"][LIST] == "a;b" and one["hot"][COUNT] == 25
    parts = list_cells(table, ["g"], "item", items_per_cell=10).orderBy("g", PART).collect()
    assert [(p.g, p[PART], p[COUNT]) for p in parts] == [("cold", 0, 2), ("hot", 0, 25), ("hot", 1, 25), ("hot", 2, 25)]
    assert ";".join(p[LIST] for p in parts if p.g == "hot") == one["hot"][LIST]
    assert parts[1][LIST].count(";") == 9


def test_reports_hold_every_piece_of_a_list(spark):
    table = [(f"f{i}", 2, "spring", f"label{i % 4}", f"stem~s{i}") for i in range(7)]
    mined = mine(spark, table, items_per_cell=3)
    whole = mine(spark, table)
    pieces = mined.terms_summary.filter("term_norm = 'stem'").orderBy(PART).collect()
    full = whole.terms_summary.filter("term_norm = 'stem'").first()
    assert [r[PART] for r in pieces] == [0, 1, 2]
    assert {(r.files_count, r.keys_count, r.occurrences_count) for r in pieces} == {(7, 4, 7)}
    assert ";".join(r.files_list for r in pieces) == full.files_list
    assert ";".join(r.keys_list for r in pieces if r.keys_list) == full.keys_list == "label0;label1;label2;label3"
    anchors = mined.relations_summary.filter("affix_role = 'prefix_anchor'").orderBy(PART).collect()
    assert [(r.affix_related_count, r.affix_related_list) for r in anchors] == [
        (7, "~s0;~s1;~s2"), (7, "~s3;~s4;~s5"), (7, "~s6"),
    ]
    cross = mined.cross_file_terms.orderBy(PART).collect()
    assert ";".join(r.cross_files_list for r in cross) == full.files_list
    assert mined.summary.first()["relations_count"] == whole.summary.first()["relations_count"] == 9
    assert mined.term_files.count() == 14 and mined.related_terms.count() == 14


# --- random cells against a fold ------------------------------------------------------


def normal(text, least=1):
    return re.sub(r"\s+", " ", text.strip())


def split(text, delimiters):
    found = [(text.find(d), i) for i, d in enumerate(delimiters) if d in text]
    if not found:
        return None
    at, i = min(found)
    body, payload = text[:at].strip(), text[at + len(delimiters[i]) :]
    return (body, delimiters[i] + payload, delimiters[i]) if body and payload.strip() else None


def fold(table, settings):
    found = []
    for path, row, version, key, text in sorted(table, key=lambda r: (r[0], r[1])):
        if settings.versions and (version or "").strip() not in settings.versions:
            continue
        if "name" in (key or "").lower() and (text or "").strip():
            found.append((path, row, (key or "").strip(), text))
        for span in re.finditer(r"(?s)(<t>)(.*?)(</t>)", text or ""):
            if span.group(2).strip():
                found.append((path, row, (key or "").strip(), span.group(2)))
    least, delimiters = settings.normalization.min_term_length, settings.affix_delimiters
    groups = defaultdict(list)
    for path, row, key, raw in found:
        if len(normal(raw)) < least:
            continue
        halves = split(raw, delimiters)
        for kind, text in [("body", halves[0]), ("suffix", halves[1])] if halves else [("body", raw)]:
            if len(normal(text)) >= least:
                groups[kind, normal(text).lower()].append((text, path, key))
    terms = {
        k: (v[0][0], len(v), ";".join(sorted({x[1] for x in v})), ";".join(sorted({x[2] for x in v if x[2]})))
        for k, v in groups.items()
    }
    pairs = defaultdict(list)
    for _, _, _, raw in found:
        halves = split(raw, delimiters)
        if halves:
            b, s = normal(halves[0]).lower(), normal(halves[1]).lower()
            if b and s and ("body", b) in terms and ("suffix", s) in terms:
                pairs[terms["body", b][0], terms["suffix", s][0]].append(halves[2])
    anchors = defaultdict(lambda: [0, set(), set()])
    for (b, s), used in pairs.items():
        for anchor in (("prefix_anchor", b, s), ("suffix_anchor", s, b)):
            entry = anchors[anchor[:2]]
            entry[0] += len(used)
            entry[1].add(anchor[2])
            entry[2] |= set(used)
    return terms, {(*k, v[0], ";".join(sorted(v[1])), ";".join(sorted(v[2]))) for k, v in anchors.items()}


@pytest.mark.parametrize("least", [1, 3])
def test_random_cells_give_what_a_fold_gives(spark, least):
    rng = random.Random(least)
    words = ["ab", "AB", "cd", " e", "f ", ":", "·", "<t>", "</t>", "é", "x y", "x\ty"]
    table = [
        (
            f"f{rng.randint(1, 4)}",
            i,
            rng.choice(["1", " 1", "2", None]),
            rng.choice(["a_name", "NAME", "other", None, " name "]),
            rng.choice([None, "", " "] + ["".join(rng.choice(words) for _ in range(rng.randint(1, 6)))] * 9),
        )
        for i in range(150)
    ]
    settings = TermConfig(
        rules=(RecordRule("r", "source", ("name",)), TagSpanRule("t", ("source",), ("<t>",), ("</t>",))),
        versions=("1",),
        normalization=Normalization(min_term_length=least),
    )
    mined = mine(spark, table, settings)
    terms, anchors = fold(table, settings)
    kinds = {r.term_id: (r.term_type, r.dedup_key) for r in mined.terms.collect()}
    got = {
        kinds[r.term_id]: (r.term_norm, r.occurrences_count, r.files_list, r.keys_list)
        for r in mined.terms_summary.collect()
    }
    assert got == terms
    relations = mined.relations_summary.filter("relation_type = 'affix_group'").collect()
    assert {
        (r.affix_role, r.affix_anchor_term, r.evidence_count, r.affix_related_list, r.affix_delimiters) for r in relations
    } == anchors
