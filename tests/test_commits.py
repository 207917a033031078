"""Files exchanged one by one: what is written, what fails alone, what a second run does."""

import os

import pandas as pd
import pytest
from helpers import rows

from keyweave.operators.rows import SyncColumns
from keyweave.plans import folders as P
from keyweave.plans.batch import FORWARD, REVERSE, BatchConfig, BatchJob
from keyweave.sources import commits as C
from keyweave.sources import readers as R

COLUMNS = SyncColumns("key", "match", ("text",))
# With ".bak" behind it, this name is longer than a file system allows.
TOO_LONG = "n" * 244 + ".parquet"


def put(path, table, columns=("key", "match", "text")):
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(table, columns=list(columns)).to_parquet(path)


def tree(folder):
    """Every file below a folder with its bytes and its time of change."""
    return {str(p.relative_to(folder)): (p.read_bytes(), p.stat().st_mtime_ns) for p in folder.rglob("*") if p.is_file()}


def master_of(spark, *table):
    return spark.createDataFrame(list(table), "row long, key string, match string, text string")


def sync(spark, folder, master, **options):
    return P.sync_folder(spark, master, COLUMNS, str(folder), COLUMNS, master_order=["row"], in_place=True, **options)


@pytest.fixture
def folder(tmp_path):
    put(tmp_path / "t/a.parquet", [("K1", "M1", "old"), ("K9", "M9", "mine")])
    put(tmp_path / "t/sub/B.parquet", [("K9", "M9", "same")])
    put(tmp_path / "t/wide.parquet", [(1, "K2", "M2", None)], ("nr", "key", "match", "text"))
    (tmp_path / "t/broken.parquet").write_bytes(b"no table")
    return tmp_path / "t"


def test_changed_files_are_exchanged_in_their_places(spark, folder):
    before = tree(folder)
    run = sync(spark, folder, master_of(spark, (2, "K1", "M1", "new"), (3, "K2", "M2", "filled")))
    after = tree(folder)
    assert after.keys() == before.keys()
    assert {n for n in after if after[n] != before[n]} == {"a.parquet", "wide.parquet"}
    assert pd.read_parquet(folder / "a.parquet").values.tolist() == [["K1", "M1", "new"], ["K9", "M9", "mine"]]
    wide = pd.read_parquet(folder / "wide.parquet")
    assert (list(wide.columns), wide.values.tolist()) == (["nr", "key", "match", "text"], [["1", "K2", "M2", "filled"]])
    assert [(r["code"], r["file_name"]) for r in run.errors.collect()] == [(R.E_TARGET_READ, "broken.parquet")]
    assert {os.path.basename(r[R.FILE]): r["cells_written"] for r in run.changed.collect()} == {"a.parquet": 1, "wide.parquet": 1}


def test_one_file_that_cannot_be_written_fails_alone(spark, folder):
    put(folder / TOO_LONG, [("K1", "M1", "old")])
    before = tree(folder)
    run = sync(spark, folder, master_of(spark, (2, "K1", "M1", "new")))
    after = tree(folder)
    assert {n for n in after if after[n] != before[n]} == {"a.parquet"} and after.keys() == before.keys()
    failed = [r for r in run.errors.collect() if r["code"] == C.E_TARGET_SAVE]
    assert [r["file_name"] for r in failed] == [TOO_LONG] and failed[0]["stage"] in (C.LOAD, C.WRITE, C.SAVE)
    assert [os.path.basename(r[R.FILE]) for r in run.changed.collect()] == ["a.parquet"]


def test_a_second_run_writes_nothing(spark, folder):
    master = master_of(spark, (2, "K1", "M1", "new"))
    sync(spark, folder, master, fill_blank_only=False)
    before = tree(folder)
    again = sync(spark, folder, master, fill_blank_only=True)
    assert tree(folder) == before and again.changed.count() == 0 and again.result.count() == 0
    # Without the rule on blanks a cell counts as written, but equal content is not exchanged.
    again = sync(spark, folder, master)
    assert [r["status"] for r in again.result.collect()] == [C.UNCHANGED]
    assert tree(folder) == before


def garbage_of_same_size(path):
    """Break a file in a way that only reading it tells."""
    stat = path.stat()
    path.write_bytes(b"?" * stat.st_size)
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))


def test_files_that_are_done_are_not_read_again(spark, folder, tmp_path):
    state = str(tmp_path / "state")
    first, second = master_of(spark, (2, "K1", "M1", "new")), master_of(spark, (2, "K1", "M1", "newer"))
    run = sync(spark, folder, first, state=state)
    assert {r["file_name"] for r in run.errors.collect()} == {"broken.parquet"}
    for name in ("sub/B.parquet", "wide.parquet"):
        garbage_of_same_size(folder / name)
    before = tree(folder)
    again = sync(spark, folder, first.repartition(3), state=state)
    assert tree(folder) == before and again.result.count() == 0 and again.changed.count() == 0
    assert {r["file_name"] for r in again.errors.collect()} == {"broken.parquet"}
    # Another master, or other rules: all files count again.
    other = sync(spark, folder, second, state=state)
    assert {r["file_name"] for r in other.errors.collect()} == {"broken.parquet", "B.parquet", "wide.parquet"}
    assert pd.read_parquet(folder / "a.parquet")["text"].tolist() == ["newer", "mine"]
    # A changed file is read again, the others are not.
    put(folder / "sub/B.parquet", [("K1", "M1", "x")])
    garbage_of_same_size(folder / "a.parquet")
    last = sync(spark, folder, second, state=state)
    assert pd.read_parquet(folder / "sub/B.parquet")["text"].tolist() == ["newer"]
    assert {r["file_name"] for r in last.errors.collect()} == {"broken.parquet", "wide.parquet"}
    with pytest.raises(ValueError, match="state"):
        P.sync_folder(spark, first, COLUMNS, str(folder), COLUMNS, master_order=["row"], state=state)


def test_batch_jobs_write_the_files_of_their_folders(spark, folder, tmp_path):
    put(tmp_path / "u/a.parquet", [("K1", "M1", "old"), ("K9", "M9", "")])
    put(tmp_path / "u/same.parquet", [("K8", "M8", "kept")])
    schema = "row long, key string, match string, fr string, es string"
    master = spark.createDataFrame([(2, "K1", "M1", "F", "E"), (3, "K2", "M2", "F2", "E2")], schema)
    jobs = (BatchJob("t", "fr"), BatchJob("none", "fr"), BatchJob("u", "es"), BatchJob("u", 99))
    config = BatchConfig(FORWARD, COLUMNS, "key", "match", jobs)
    before = tree(tmp_path / "u")
    folders = {"t": str(folder), "u": str(tmp_path / "u"), "none": str(tmp_path / "nowhere")}
    batch = P.batch_on_folders(spark, config, master, folders, master_order=["row"])
    assert [r[2:4] for r in batch.run.results] == [("success", 2), ("failed", 0), ("success", 1), ("failed", 0)]
    assert pd.read_parquet(folder / "a.parquet")["text"].tolist() == ["F", "mine"]
    assert pd.read_parquet(folder / "wide.parquet").values.tolist() == [["1", "K2", "M2", "F2"]]
    assert pd.read_parquet(tmp_path / "u/a.parquet")["text"].tolist() == ["E", ""]
    after = tree(tmp_path / "u")
    assert after["same.parquet"] == before["same.parquet"]
    assert {n: sorted(os.path.basename(r[R.FILE]) for r in f.changed.collect()) for n, f in batch.folders.items()} == {
        1: ["a.parquet", "wide.parquet"],
        3: ["a.parquet"],
    }
    assert [r["file_name"] for r in batch.folders[1].errors.collect()] == ["broken.parquet"]
    back = BatchConfig(REVERSE, COLUMNS, "key", "match", (BatchJob("u", "fr"), BatchJob("t", "es")))
    run = P.batch_on_folders(spark, back, master, folders, master_order=["row"]).run
    assert rows(run.master.select("fr", "es"), "row") == [("E", "F"), ("F2", "F2")] and tree(tmp_path / "u") == after


def test_no_two_places_for_the_result(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="not both"):
        sync(spark, folder, master_of(spark, (2, "K1", "M1", "new")), out=str(tmp_path / "out"))


def test_rows_keep_their_order_in_a_file(spark, tmp_path):
    table = [(f"K{i % 7}", "M", str(i)) for i in range(3000)]
    put(tmp_path / "t/long.parquet", table)
    sync(spark, tmp_path / "t", master_of(spark, (2, "K3", "M", "new")))
    got = pd.read_parquet(tmp_path / "t/long.parquet").values.tolist()
    assert got == [[k, m, "new" if k == "K3" else t] for k, m, t in table]


def test_replacement_takes_effect(spark, tmp_path):
    """Raw bytes count, the first target and the last source of a name, and names without a partner."""
    put(tmp_path / "no_rows.parquet", [])
    no_rows = (tmp_path / "no_rows.parquet").read_bytes()
    for place, content in {
        "s/a.parquet": b"new a",
        "s/x/a.parquet": b"newest a",
        "s/empty.parquet": no_rows,
        "s/alone.parquet": b"no partner",
        "s/A.parquet": b"other case",
        "s/note.txt": b"other kind",
        f"s/{TOO_LONG}": b"never arrives",
        "t/a.parquet": b"old a",
        "t/z/a.parquet": b"second a",
        "t/empty.parquet": b"was full",
        "t/note.txt": b"stays",
        f"t/{TOO_LONG}": b"stays too",
    }.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(content)
    run = P.replace_in_folder(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    target = {name: content for name, (content, _) in tree(tmp_path / "t").items()}
    assert target == {
        "a.parquet": b"newest a",
        "z/a.parquet": b"second a",
        "empty.parquet": no_rows,
        "note.txt": b"stays",
        TOO_LONG: b"stays too",
    }
    status = {os.path.basename(r["source"]): r["status"] for r in run.result.collect()}
    assert status == {
        "a.parquet": C.REPLACED,
        "empty.parquet": C.REPLACED,
        TOO_LONG: C.FAILED,
        "alone.parquet": "unmatched",
        "A.parquet": "unmatched",
    }
    errors = run.errors.collect()
    assert [(r["code"], r["file_name"]) for r in errors] == [(R.E_REPLACE_FILE, TOO_LONG)]
    before = tree(tmp_path / "t")
    again = P.replace_in_folder(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    assert tree(tmp_path / "t") == before and again.changed.count() == 0
    with pytest.raises(ValueError, match="apart"):
        P.replace_in_folder(spark, str(tmp_path / "s"), str(tmp_path / "s/x"))


@pytest.mark.parametrize("place", [None, b"old", b"new"])
def test_a_task_that_died_is_finished(tmp_path, place):
    """Between the renames the place is empty, after them the old file lies beside the new one."""
    target, source = tmp_path / "f", tmp_path / "s"
    source.write_bytes(b"new")
    (tmp_path / "f.bak").write_bytes(b"old")
    if place:
        target.write_bytes(place)
    assert C._exchange(str(target), str(source)) == (C.REPLACED, None, None)
    assert target.read_bytes() == b"new" and sorted(p.name for p in tmp_path.iterdir()) == ["f", "s"]


def test_exchange_of_single_files(spark, tmp_path):
    """A place without a file gets one; a source that is not there fails and leaves all as it was."""
    (tmp_path / "s").write_bytes(b"x" * (3 << 20))
    (tmp_path / "kept").write_bytes(b"kept")
    pairs = [(f"{tmp_path}/made", f"{tmp_path}/s"), (f"{tmp_path}/kept", f"{tmp_path}/none")]
    log = C.exchange_files(spark.createDataFrame(pairs, "path string, source string"))
    assert rows(log.select("status", "stage"), "status") == [(C.FAILED, C.LOAD), (C.REPLACED, None)]
    assert (tmp_path / "made").stat().st_size == 3 << 20 and (tmp_path / "kept").read_bytes() == b"kept"
    assert C.exchange_files(spark.createDataFrame([], "path string, source string")).count() == 0


def test_a_large_file_is_sorted_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task sorts a whole file; the pieces are one file again, in order, with Spark's types, and the same bytes each time."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(C, "_RANGE_ROWS", 100)
    monkeypatch.setattr(C, "_BLOCK_ROWS", 64)
    monkeypatch.setattr(C, "_GROUP_BYTES", 5_000)
    put_together, pieces_seen = C._put_together, spark.sparkContext.accumulator(0)

    def counted(pieces, path, kind):
        pieces_seen.add(len(pieces))
        put_together(pieces, path, kind)

    monkeypatch.setattr(C, "_put_together", counted)
    time = F.timestamp_micros(F.col("id") * 1_000_003 + 5)
    table = spark.range(3000).select(
        F.concat(F.lit(f"{tmp_path}/w/"), F.when(F.col("id") % 10 > 0, "large").otherwise("small"), F.lit(".parquet")).alias("file"),
        "id",
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), "id")).alias("text"),
        (F.col("id") / 7).cast("decimal(12,3)").alias("exact"),
        F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("day"),
        time.alias("time"),
        time.cast("timestamp_ntz").alias("clock"),
        F.array(time, F.lit(None)).alias("times"),
        F.struct(F.lit(None).cast("int").alias("none"), time.alias("time")).alias("both"),
        F.create_map(F.lit("k"), "id").alias("of"),
        F.lit(None).cast("string").alias("never"),
    )
    log = C.write_files(table.repartition(5, F.rand(1)), file="file", row=["id"]).collect()
    assert [r["status"] for r in log] == [C.REPLACED] * 2 and pieces_seen.value >= 30
    before = tree(tmp_path / "w")
    for name, condition in (("large", "id % 10 > 0"), ("small", "id % 10 = 0")):
        found = spark.read.parquet(f"{tmp_path}/w/{name}.parquet")
        want = table.where(condition).drop("file")
        assert found.dtypes == want.dtypes
        assert found.collect() == want.orderBy("id").collect()
        assert found.inputFiles() and len(found.inputFiles()) == 1
    again = C.write_files(table.repartition(3, F.rand(2)), file="file", row=["id"]).collect()
    assert [r["status"] for r in again] == [C.UNCHANGED] * 2 and tree(tmp_path / "w") == before
