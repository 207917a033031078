"""The pipeline against plain versions of its stages, and the entry with and without the package."""

import builtins
import importlib
import sys

import pytest
from llm_helpers import plain_quality
from pyspark.sql import functions as F
from test_decontamination import plain_matches
from test_similar import plain_kept

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of every stage, each on what the one before it kept."""
    import corpus_pipeline as p

    docs, found = p.table(spark, FOLDER, "documents"), []
    for name, stage in p.STAGES:
        out = p.materialize(stage(spark, docs, FOLDER), "stage")
        found.append((name, docs, out))
        docs = out
    return found


def test_stages_keep_the_columns(stages):
    assert [name for name, *_ in stages] == [
        "language ID", "quality rules", "SimHash near-dedup", "benchmark decontamination", "packing",
    ]
    for _, before, after in stages[:-1]:
        assert after.schema == before.schema


def test_language_stage_keeps_what_has_a_language(stages):
    _, before, after = stages[0]
    asked = rows_of(before)
    kept = rows_of(after)
    assert all(any(map(str.isalpha, asked[i])) for i in kept)
    assert len(kept) >= 0.99 * len(asked)


def test_quality_stage_applies_its_rules(stages):
    from keyweave.llm.quality import STOP_LANGUAGES, STOP_WORDS

    _, before, after = stages[1]
    kept = rows_of(after)
    assert 0 < len(kept) < before.count()
    for row in before.collect():
        text = row["text"]
        n, chars, symbols, dup, repeat = plain_quality(text)
        lines = [x for x in text.split("\n") if x.strip()]
        good = (
            n >= 50
            and 100 * repeat <= 50 * n
            and 2 <= chars / n <= 20
            and symbols / n <= 0.5
            and (row["lang"] not in STOP_LANGUAGES or sum(w.lower() in STOP_WORDS for w in text.split()) / n >= 0.05)
            and dup / len(lines) <= 0.5
        )
        assert (row["doc_id"] in kept) == good


def test_duplicate_stage_keeps_the_smallest_of_each_component(stages):
    """Components of texts with a five-word similarity of 0.8 or more, by comparing all with all."""
    _, before, after = stages[2]
    assert rows_of(after).keys() == plain_kept(sorted(rows_of(before).items()))


def test_decontamination_stage_drops_all_leaks(spark, stages):
    _, before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = sorted(rows_of(before).items())
    leaks = plain_matches([t for _, t in rows], items)
    assert rows_of(after).keys() == {i for at, (i, _) in enumerate(rows) if at not in leaks}


def test_packing_stage_covers_every_document(stages):
    _, before, after = stages[4]
    whole = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in whole} == rows_of(before).keys()
    assert all(r["n"] == r["all"] for r in whole)


def test_stages_take_any_rows(spark):
    """NULL in any column, repeated rows, very long texts, columns with clashing names, and no rows at all."""
    import corpus_pipeline as p

    docs = p.table(spark, FOLDER, "documents").limit(60)
    odd = [(None, docs.first()["text"], None, None, None), (70_007, None, "en", "s", 0), (70_007, "", None, "s", 0), (70_008, "1 2 3 " * 40, "en", "s", 1)]
    long_text = " ".join(r["text"] for r in docs.collect())
    odd += [(70_009, long_text, "en", "s", 1)] * 2
    mixed = docs.union(spark.createDataFrame(odd, docs.schema))
    mixed = mixed.withColumns({c: F.lit(i) for i, c in enumerate(["fp", "key", "_row", "hash", "class", "kept", "score", "rejected", "length"])})
    for rows in (mixed, mixed.limit(0)):
        for name, stage in p.STAGES[:-1]:
            kept = p.materialize(stage(spark, rows, FOLDER), "odd")
            assert kept.schema.names == mixed.columns, name
            assert kept.exceptAll(rows).count() == 0, name
            rows = kept
        packed = p.STAGES[-1][1](spark, rows, FOLDER)
        assert packed.count() >= rows.count()
        assert rows.where("doc_id = 70009").count() <= 1 and rows.where("doc_id in (70007, 70008)").count() == 0


def test_run_gives_what_the_stages_give(spark, stages):
    import corpus_pipeline

    def bag(df):
        return sorted(map(str, df.collect()))

    assert bag(corpus_pipeline.run(spark, FOLDER)) == bag(stages[-1][2])


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


def test_entry_works_without_the_package(monkeypatch):
    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("keyweave.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setattr(builtins, "__import__", real)
    assert entry.queries() and not any(x.startswith("op") or x == "pipeline" for x in entry.queries())
    sys.modules.pop("__spark_entry__", None)
