"""Folders of files: listing, order, unreadable files, and everything that is written."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from keyweave import session
from keyweave.operators.columns import clear_column
from keyweave.operators.rows import SyncColumns, resolve_layout
from keyweave.operators.sync import sync_reverse, sync_single
from keyweave.plans import folders as P
from keyweave.plans.master_update import EXISTING_KEY_ONLY, OVERWRITE_NON_BLANK, UpdatePolicies
from keyweave.plans.mine_terms import mine_terms
from keyweave.plans.term_config import RecordRule, TermConfig
from keyweave.sources import readers as R
from keyweave.sources import writers as W

SCHEMA = "key string, match string, text string"


@pytest.fixture
def folder(spark, tmp_path):
    """a.parquet, sub/B.parquet, ~$a.parquet, note.txt, and a file that is no table."""

    def put(name, table):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        spark.createDataFrame(table, SCHEMA).toPandas().to_parquet(path)

    put("in/a.parquet", [("K1", "M1", "from_a"), ("K2", "M1", "only_a")])
    put("in/sub/B.parquet", [("K1", "M1", "from_b")])
    put("in/~$a.parquet", [("K1", "M1", "temporary")])
    (tmp_path / "in/note.txt").write_text("no table")
    (tmp_path / "in/z.parquet").write_bytes(b"not a parquet file")
    return str(tmp_path / "in")


def test_listing(spark, folder):
    names = lambda **o: sorted(r.file_name for r in R.list_files(spark, folder, **o).collect())
    assert names() == ["B.parquet", "a.parquet", "z.parquet"]
    assert names(include_temp_files=True) == ["B.parquet", "a.parquet", "z.parquet", "~$a.parquet"]
    assert names(extensions=(".PARQUET",)) == names()
    assert names(extensions=(".PARQUET",), case_sensitive=True) == []
    assert names(extensions=(".txt",)) == ["note.txt"]


def test_configured_files(spark):
    files = ["abc.xlsx", "ABC.xls", "abc.tar.gz", "other.xlsx", ".hidden", "abc"]
    df = spark.createDataFrame([(f,) for f in files], "n string")
    pick = lambda *tokens: [r.n for r in df.filter(R.is_configured(F.col("n"), tokens)).collect()]
    assert pick() == files
    assert pick("abc") == ["abc.xlsx", "ABC.xls", "abc"]
    assert pick(" ABC.XLSX ", "") == ["abc.xlsx"]
    assert pick("abc.tar") == []
    assert pick(".hidden") == [".hidden"]


def test_a_bad_file_is_an_error_row(spark, folder):
    scan = R.scan_folder(spark, folder, error_code=R.E_TARGET_READ)
    assert (scan.files_read, scan.files_failed) == (2, 1)
    (error,) = scan.errors.collect()
    assert (error.code, error.file_name) == (R.E_TARGET_READ, "z.parquet") and error.message
    got = rows(R.order_by_path(scan.rows).select(R.NAME, R.ROW, "text"), R.ORDER, R.ROW)
    assert got == [("a.parquet", 2, "from_a"), ("a.parquet", 3, "only_a"), ("B.parquet", 2, "from_b")]
    # The good files are used all the same.
    master = spark.createDataFrame([(2, "K1", "M1", ""), (3, "K2", "M1", "x")], f"row long, {SCHEMA}")
    columns = SyncColumns("key", "match", ("text",))
    result = sync_reverse(master, columns, R.order_by_path(scan.rows), columns, master_place=["row"], target_order=R.FOLDER_ORDER)
    assert [r.text for r in result.orderBy("row").collect()] == ["from_b", "only_a"]


def test_a_file_damaged_in_the_middle_is_found_by_reading_it(spark, folder, tmp_path):
    path = tmp_path / "in/a.parquet"
    data = bytearray(path.read_bytes())
    data[4:40] = b"\xff" * 36
    path.write_bytes(data)
    assert R.scan_folder(spark, folder).files_failed == 1
    assert R.scan_folder(spark, folder, whole=True).files_failed == 2


def test_missing_columns_fail_the_file(spark, folder, tmp_path):
    spark.createDataFrame([("K", "M")], "KEY string, match string").toPandas().to_parquet(tmp_path / "in/c.parquet")
    scan = R.scan_folder(spark, folder, required=["key", "text"])
    messages = {r.file_name: r.message for r in scan.errors.collect()}
    assert messages["c.parquet"] == "columns not found: text"
    assert scan.files_read == 2


def test_order_rules(spark, folder):
    scan = R.scan_folder(spark, folder, exclude=[f"{folder}/a.parquet"])
    assert scan.files_read == 1
    scan = R.scan_folder(spark, folder)
    by_name = rows(R.order_by_name(scan.rows).select(R.NAME), R.ORDER, R.ROW)
    assert [r[0] for r in by_name] == ["a.parquet", "a.parquet", "B.parquet"]
    listed = [f"{folder}/sub/B.parquet", "", f"{folder}/./a.parquet", f"{folder}/sub/B.parquet"]
    ordered = R.order_by_priority(scan.rows, listed)
    assert rows(ordered.select(R.NAME, R.ORDER, R.ROW), R.ORDER, R.ROW) == [("B.parquet", 0, 2), ("a.parquet", 1, 2), ("a.parquet", 1, 3)]
    assert R.order_by_priority(scan.rows, listed[:1]).count() == 1
    with pytest.raises(ValueError):
        R.order_by_priority(scan.rows, [" "])


def test_csv_and_json_bring_their_row_numbers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("nr,key,match\n2,K,M\n3,L,M\n")
    (tmp_path / "t.json").write_text('{"nr": 2, "key": "J"}\n')
    scan = R.scan_folder(spark, str(tmp_path), kind="csv", row="nr")
    assert rows(scan.rows.select(R.ROW, "key"), R.ROW) == [(2, "K"), (3, "L")]
    assert rows(R.scan_folder(spark, str(tmp_path), kind="json", row="nr").rows.select(R.ROW, "key")) == [(2, "J")]
    with pytest.raises(ValueError, match="row numbers"):
        R.scan_folder(spark, str(tmp_path), kind="csv")
    with pytest.raises(ValueError, match="no file that can be read"):
        R.scan_folder(spark, str(tmp_path))


def test_files_may_differ_in_columns_and_types(spark, tmp_path):
    spark.createDataFrame([(1, 0.5)], "Key int, text double").toPandas().to_parquet(tmp_path / "a.parquet")
    spark.createDataFrame([("K", "M")], "key string, match string").toPandas().to_parquet(tmp_path / "b.parquet")
    spark.createDataFrame([([1],)], "key array<int>").toPandas().to_parquet(tmp_path / "c.parquet")
    scan = R.scan_folder(spark, str(tmp_path))
    assert rows(scan.rows.select("key", "text", "match"), R.NAME) == [("1", "0.5", None), ("K", None, "M")]
    assert "no cell text" in scan.errors.first().message


def test_column_edits_count_the_columns_of_each_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("1", "2")], "a string, b string").toPandas().to_parquet(tmp_path / "in/a.parquet")
    spark.createDataFrame([("1", "3")], "b string, a string").toPandas().to_parquet(tmp_path / "in/b.parquet")
    out = str(tmp_path / "out")
    run = P.edit_folder(spark, str(tmp_path / "in"), clear_column, 1, out)
    assert run.result.count() == 2
    assert rows(spark.read.parquet(out).select("a", "b"), R.NAME) == [(None, "2"), ("3", None)]


def test_folder_tools(spark, folder, tmp_path):
    columns = SyncColumns("key", "match", ("text",))
    master = spark.createDataFrame([(2, "K1", "M1", "m1"), (3, "K3", "M1", "m3")], f"row long, {SCHEMA}")
    out = str(tmp_path / "out")
    run = P.sync_folder(spark, master, columns, folder, columns, master_order=["row"], out=out)
    assert sorted(r.cells_written for r in run.changed.collect()) == [1, 1]
    assert run.errors.count() == 1
    assert rows(spark.read.parquet(out).select("text"), R.NAME, R.ROW) == [("m1",), ("m1",), ("only_a",)]

    run = P.reverse_folder(spark, master, columns, folder, columns, master_place=["row"])
    assert rows(run.result.select("text"), "row") == [("from_b",), ("m3",)]

    layout = resolve_layout(["key", "match", "text"], "key", "match")
    run = P.update_from_folder(spark, master, folder, layout, row="row")
    assert rows(run.result.master, "row")[2:] == [(4, "K2", "M1", "only_a")]
    # The file listed last wins.
    listed = [f"{folder}/sub/B.parquet", f"{folder}/a.parquet"]
    sparse = UpdatePolicies(OVERWRITE_NON_BLANK, EXISTING_KEY_ONLY)
    run = P.update_from_folder(spark, master, folder, layout, sparse, row="row", priority=listed)
    assert rows(run.result.master, "row")[0] == (2, "K1", "M1", "from_a")
    assert [r.source_file for r in run.result.unmatched.collect()] == ["a.parquet"]

    run = P.stats_of_folder(spark, folder, source="key", translation="text", mode="english_words")
    assert sorted(r.file_name for r in run.result.collect()) == ["B.parquet", "a.parquet", "z.parquet"]

    settings = TermConfig((RecordRule("r", "text", ("k",)),), files=("a", "z"))
    run = P.mine_folder(spark, folder, settings)
    assert [r.term_norm for r in run.result.terms.orderBy("term_norm").collect()] == ["from_a", "only_a"]
    summary = run.result.summary.first()
    assert (summary.files_total, summary.files_succeeded, summary.files_failed) == (2, 1, 1)
    assert run.errors.first().code == R.E_TERMINOLOGY_FILE


def test_replace_from_folder(spark, folder, tmp_path):
    (tmp_path / "new").mkdir()
    spark.createDataFrame([("N", "1")], "key string, more string").toPandas().to_parquet(tmp_path / "new/a.parquet")
    done = P.replace_from_folder(spark, str(tmp_path / "new"), folder).result
    assert rows(done.targets.select("key", "more", "text"), R.NAME, "key") == [("K1", None, "from_b"), ("N", "1", None)]


NAMES = ["plain", "with space", "50%25off", "中文", "a#b", "a+b", "q[1]{2}*"]


def test_files_of_any_name_are_read(spark, tmp_path):
    for i, name in enumerate(NAMES):
        table = spark.createDataFrame([("k", "m", f"v{i}")], SCHEMA).toPandas()
        table.to_parquet(tmp_path / f"{name}.parquet")
    scan = R.scan_folder(spark, str(tmp_path))
    assert (scan.files_read, scan.files_failed) == (len(NAMES), 0)
    got = {r[R.NAME]: (r.text, r[R.FILE]) for r in scan.rows.collect()}
    listed = {r.file_name: r.path for r in scan.files.collect()}
    assert {name: text for name, (text, _) in got.items()} == {f"{n}.parquet": f"v{i}" for i, n in enumerate(NAMES)}
    assert listed == {name: path for name, (_, path) in got.items()}
    paths = [f"{tmp_path}/{n}.parquet" for n in reversed(NAMES)]
    ordered = rows(R.order_by_priority(scan.rows, paths).select(R.NAME), R.ORDER)
    assert [r[0] for r in ordered] == [f"{n}.parquet" for n in reversed(NAMES)]
    stats = P.stats_of_folder(spark, str(tmp_path), source="key", translation="text", mode="english_words").result
    assert {(r.file_name, r.total_rows) for r in stats.collect()} == {(f"{n}.parquet", 1) for n in NAMES}


def test_files_of_one_name_are_counted_apart(spark, tmp_path):
    for place, n in (("x", 1), ("y", 2)):
        (tmp_path / place).mkdir()
        spark.createDataFrame([("k", "m", "")] * n, SCHEMA).toPandas().to_parquet(tmp_path / place / "a.parquet")
    stats = P.stats_of_folder(spark, str(tmp_path), source="key", translation="text", mode="english_words").result
    found = sorted((r.path.split("/")[-2], r.file_name, r.total_rows, r.untranslated_rows) for r in stats.collect())
    assert found == [("x", "a.parquet", 1, 1), ("y", "a.parquet", 2, 2)]


def test_the_report_of_a_folder_ends_with_its_totals(spark, tmp_path):
    for name, texts in (("b", ["", "done"]), ("a", ["", ""]), ("x/a", ["done"])):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        spark.createDataFrame([("two words", "m", t) for t in texts], SCHEMA).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "z.parquet").write_bytes(b"no table")
    run = P.stats_report_of_folder(
        spark, str(tmp_path), source="key", translation="text", mode="english_words", out=str(tmp_path / "reports")
    )
    want = [("a.parquet", 0, 0, 2, 1), ("a.parquet", 4, 2, 4, 2), ("b.parquet", 2, 1, 4, 2), ("z.parquet", 0, 0, 0, 0)]
    got = [tuple(r) for r in run.result.collect()]
    assert got[:-1] == want and got[-1][1:] == (6, 3, 10, 5)
    assert run.errors.count() == 1 and run.result.columns[0] != "file_name"
    written = spark.read.parquet(run.changed.first().path)
    assert [tuple(r) for r in written.collect()] == got and written.columns == run.result.columns


def test_an_empty_source_file_empties_its_target(spark, folder, tmp_path):
    (tmp_path / "new").mkdir()
    spark.createDataFrame([], SCHEMA).toPandas().astype("string").to_parquet(tmp_path / "new/a.parquet")
    done = P.replace_from_folder(spark, str(tmp_path / "new"), folder).result
    assert rows(done.targets.select(R.NAME, "text")) == [("B.parquet", "from_b")]
    assert [r.target_path.endswith("/in/a.parquet") for r in done.replaced.collect()] == [True]


def test_the_master_is_no_source_and_empty_files_count(spark, tmp_path):
    spark.createDataFrame([("K1", "M1", "own")], SCHEMA).toPandas().to_parquet(tmp_path / "master.parquet")
    spark.createDataFrame([("K2", "M2", "new")], SCHEMA).toPandas().to_parquet(tmp_path / "b.parquet")
    spark.createDataFrame([], SCHEMA).toPandas().astype("string").to_parquet(tmp_path / "c.parquet")
    master = spark.createDataFrame([(2, "K1", "M1", "")], f"row long, {SCHEMA}")
    run = P.update_from_folder(
        spark, master, str(tmp_path), resolve_layout(["key", "match", "text"], "key", "match"),
        row="row", master_path=f"{tmp_path}/master.parquet",
    )
    assert [r.key for r in run.result.master.orderBy("row").collect()] == ["K1", "K2"]
    assert run.result.counters.first().source_files == 2


def test_two_stages_from_two_folders(spark, tmp_path):
    for place, rows_ in (("one", [("K1", "M9", "dense"), ("K2", "M2", "added")]), ("two", [("K2", "M2", "sparse"), ("K7", "M7", "x")])):
        (tmp_path / place).mkdir()
        spark.createDataFrame(rows_, SCHEMA).toPandas().to_parquet(tmp_path / place / "f.parquet")
    (tmp_path / "two/bad.parquet").write_bytes(b"no table")
    master = spark.createDataFrame([(2, "K1", "M1", "old")], f"row long, {SCHEMA}")
    layout = resolve_layout(["key", "match", "text"], "key", "match")
    first, second = P.two_stages_from_folders(spark, master, f"{tmp_path}/one", f"{tmp_path}/two", layout, row="row")
    assert rows(first.result.master, "row") == [(2, "K1", "M9", "dense"), (3, "K2", "M2", "added")]
    assert rows(second.result.master, "row") == [(2, "K1", "M9", "dense"), (3, "K2", "M2", "sparse")]
    assert (first.errors.count(), second.errors.count()) == (0, 1)
    assert [r.key for r in second.result.unmatched.collect()] == ["K7"]
    assert first.result.counters.first().source_files == second.result.counters.first().source_files == 1


def test_csv_keeps_its_header_and_its_separator(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.csv").write_text("nr;key;match;text\n2;K;M;\n")
    options = {"sep": ";"}
    columns = SyncColumns("key", "match", ("text",))
    master = spark.createDataFrame([(2, "K", "M", "new")], f"row long, {SCHEMA}")
    scan = R.scan_folder(spark, str(tmp_path / "in"), kind="csv", row="nr", options=options)
    assert scan.files_failed == 0
    result = sync_single(scan.rows, columns, master, columns, target_place=[R.FILE, R.ROW], master_order=["row"])
    W.write_changed_files(result.drop(R.NAME), str(tmp_path / "out"), file=R.FILE, kind="csv")
    again = R.scan_folder(spark, str(tmp_path / "out"), kind="csv", row=R.ROW)
    assert rows(again.rows.select(R.ROW, "key", "text")) == [(2, "K", "new")]


def test_no_folder_is_rewritten_or_doubled(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    P.edit_folder(spark, folder, clear_column, 1, out)
    with pytest.raises(Exception, match="already exists"):
        P.edit_folder(spark, folder, clear_column, 1, out)
    for place in (folder, f"{folder}/sub", str(tmp_path)):
        with pytest.raises(ValueError, match="apart"):
            P.edit_folder(spark, folder, clear_column, 1, place)


def test_only_changed_files_are_written(spark, tmp_path):
    out = str(tmp_path / "out")
    targets = spark.createDataFrame(
        [("a", 2, "K", "M", ""), ("a", 3, "Z", "M", "z"), ("b", 2, "Z", "M", "b")], f"file string, row long, {SCHEMA}"
    )
    targets.write.partitionBy("file").parquet(out)
    before = sorted(p.name for p in (tmp_path / "out/file=b").iterdir())
    columns = SyncColumns("key", "match", ("text",))
    master = spark.createDataFrame([(2, "K", "M", "new")], f"row long, {SCHEMA}")
    # The folder is rewritten from its own rows.
    stored = spark.read.parquet(out)
    result = sync_single(stored, columns, master, columns, target_place=["file", "row"], master_order=["row"])
    assert rows(W.write_changed_files(result, out, file="file")) == [("a", 1)]
    assert sorted(p.name for p in (tmp_path / "out/file=b").iterdir()) == before
    assert rows(spark.read.parquet(out).select("file", "row", "text"), "file", "row") == [("a", 2, "new"), ("a", 3, "z"), ("b", 2, "b")]
    none = sync_single(spark.read.parquet(out), columns, master.limit(0), columns, target_place=["file", "row"], master_order=["row"])
    assert W.write_changed_files(none, str(tmp_path / "never"), file="file").count() == 0
    assert not (tmp_path / "never").exists()


def test_reports_never_replace_one_another(spark, tmp_path):
    report = spark.createDataFrame([], "key string, match string, source_file string")
    paths = [W.write_report(report, str(tmp_path)) for _ in range(3)]
    assert [p.rsplit("/", 1)[1] for p in paths] == [W.UNMATCHED_REPORT, f"{W.UNMATCHED_REPORT} (1)", f"{W.UNMATCHED_REPORT} (2)"]
    assert spark.read.parquet(paths[0]).columns == report.columns


def test_term_reports(spark, tmp_path):
    cells = spark.createDataFrame([("f", 2, "name", "a:b"), ("g", 2, "name", "a")], "path string, row long, key string, source string")
    mined = mine_terms(cells, TermConfig((RecordRule("r", "source", ("name",)),)), path="path", row="row")
    paths = W.write_term_reports(mined, str(tmp_path / "run"))
    assert sorted(paths) == ["details", "relations_summary", "review", "terms_summary"]
    assert spark.read.parquet(paths["details"]).count() == 3
    assert spark.read.parquet(paths["terms_summary"]).columns[:3] == ["term_id", "term_type", "term_norm"]


def test_intermediate_tables_use_the_folder_of_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.intermediate_path(spark, "x").startswith(root)
    assert session.materialize(spark.range(3), "three").count() == 3


@pytest.fixture
def no_driver_lists(monkeypatch):
    """How many rows each collect brought to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    brought, real = [], DataFrame.collect

    def collect(self):
        found = real(self)
        brought.append(len(found))
        return found

    monkeypatch.setattr(DataFrame, "collect", collect)
    return brought


def test_thousands_of_files_are_read_without_a_list_on_the_driver(spark, tmp_path, no_driver_lists):
    import pyarrow as pa
    from pyarrow import parquet

    (tmp_path / "in").mkdir()
    for i in range(2000):
        more = {"extra": [i]} if i % 10 == 0 else {}
        table = pa.table({"key": [f"K{i}", "L"], "match": ["M", None], "number": [0.5, 2.0]} | {k: v * 2 for k, v in more.items()})
        if i % 100 == 7:
            (tmp_path / f"in/f{i}.parquet").write_bytes(b"no table")
        else:
            parquet.write_table(table, tmp_path / f"in/f{i}.parquet")
    scan = R.scan_folder(spark, str(tmp_path / "in"), most_listed=100)
    assert (scan.files_read, scan.files_failed, len(scan.tables)) == (1980, 20, 2)
    assert max(no_driver_lists) <= 2
    listed = R.scan_folder(spark, str(tmp_path / "in"))
    assert scan.errors.count() == 20 and scan.files.count() == 1980
    assert scan.files.subtract(listed.files).count() == 0 and scan.errors.subtract(listed.errors).count() == 0
    assert scan.rows.columns == listed.rows.columns and scan.rows.count() == listed.rows.count() == 3960
    assert scan.rows.exceptAll(listed.rows).count() == 0


def test_both_ways_to_read_give_the_same_cells(spark, tmp_path):
    """Types of all kinds, several batches, names with blanks and signs, an empty file."""
    wide = spark.range(3000).selectExpr(
        "id", "CAST(id AS INT) AS i", "id / 4 AS d", "CAST(id AS DECIMAL(12,2)) AS c", "id % 2 = 0 AS b", "CAST(NULL AS STRING) AS n",
        "DATE'2026-03-16' + CAST(id % 9 AS INT) AS day", "TIMESTAMP'2026-03-16 01:02:03' AS at", "CAST(id AS FLOAT) / 3 AS f",
    ).toPandas()
    (tmp_path / "in/a b").mkdir(parents=True)
    wide.to_parquet(tmp_path / "in/a b/x+%20#.parquet", coerce_timestamps="us", row_group_size=1000)
    wide.head(0).to_parquet(tmp_path / "in/none.parquet", coerce_timestamps="us")
    by_spark, by_task = (R.scan_folder(spark, str(tmp_path / "in"), most_listed=n).rows for n in (10, 0))
    assert by_task.columns == by_spark.columns and by_task.count() == 3000
    assert by_task.exceptAll(by_spark).count() == 0
