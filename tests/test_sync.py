"""Forward and reverse sync: small tables with known results, and random tables against a fold."""

import random

import pytest
from helpers import rows

from keyweave.operators.rows import SyncColumns, columns_at, resolve_layout
from keyweave.operators.sync import WRITTEN, sync_multi, sync_reverse, sync_single, written_by_file, written_total

MASTER = "row long, key string, match string, value string"
TARGET = "file string, row long, key string, match string, translation string"
SOURCE = SyncColumns("key", "match", ("value",))
TARGETS = SyncColumns("key", "match", ("translation",))


def forward(spark, master, targets, **flags):
    return sync_single(
        spark.createDataFrame(targets, TARGET),
        TARGETS,
        spark.createDataFrame(master, MASTER),
        SOURCE,
        target_place=["file", "row"],
        master_order=["row"],
        **flags,
    )


def reverse(spark, master, targets, **flags):
    return sync_reverse(
        spark.createDataFrame(master, MASTER),
        SOURCE,
        spark.createDataFrame(targets, TARGET),
        TARGETS,
        master_place=["row"],
        target_order=["file", "row"],
        **flags,
    )


def cells(df, *order):
    return [(r[-2], r[-1]) for r in rows(df, *order)]


def test_fill_blank_only_keeps_what_is_there(spark):
    targets = [("t", 2, "K1", "M1", ""), ("t", 3, "K1", "M1", "keep-me")]
    result = forward(spark, [(2, "K1", "M1", "V1")], targets, fill_blank_only=True)
    assert cells(result, "row") == [("V1", 1), ("keep-me", 0)]
    assert rows(written_total(result)) == [(1,)]


def test_an_equal_value_counts_as_written(spark):
    assert cells(forward(spark, [(2, "K", "M", "V")], [("t", 2, "K", "M", "V")])) == [("V", 1)]


def test_a_later_blank_master_row_hides_an_earlier_value(spark):
    master = [(2, "K", "M", "V"), (3, "K ", " M", "  ")]
    assert cells(forward(spark, master, [("t", 2, "K", "M", "old")])) == [("old", 0)]
    assert cells(forward(spark, master, [("t", 2, "K", "M", "old")], allow_blank_write=True)) == [("  ", 1)]


def test_rows_without_identity_stay(spark):
    targets = [("t", 2, None, "M", "a"), ("t", 3, "K", " ", None), ("t", 4, "K", "X", "c")]
    result = forward(spark, [(2, "K", "M", "V"), (3, "", "M", "W")], targets)
    assert cells(result, "row") == [("a", 0), (None, 0), ("c", 0)]


def test_several_columns_are_written_cell_by_cell(spark):
    master = spark.createDataFrame(
        [(2, "K1", "M1", "A1", ""), (3, "K2", "M2", "B1", "B2")],
        "row long, key string, match string, v1 string, v2 string",
    )
    targets = spark.createDataFrame(
        [("t", 2, "K1", "M2", "W1", "W2", "W3"), ("t", 3, "K1", "M1", "", "OLD", "x"), ("t", 4, "K2", "M2", "o", None, "y")],
        "file string, row long, key string, match string, out1 string, out2 string, out3 string",
    )
    options = dict(target_place=["file", "row"], master_order=["row"])
    got = sync_multi(
        targets,
        SyncColumns("key", "match", ("out1", "out2", "out3")),
        master,
        SyncColumns("key", "match", ("v1", "v2", "not_there")),
        **options,
    )
    assert [r[4:] for r in rows(got, "row")] == [("W1", "W2", "W3", 0), ("A1", "OLD", "x", 1), ("B1", "B2", "y", 2)]
    got = sync_multi(
        targets,
        SyncColumns("key", "match", ("out1", "out2", "out3")),
        master,
        SyncColumns("key", "match", ("v1", "v2", "not_there")),
        fill_blank_only=True,
        **options,
    )
    assert [r[4:] for r in rows(got, "row")] == [("W1", "W2", "W3", 0), ("A1", "OLD", "x", 1), ("o", "B2", "y", 1)]
    with pytest.raises(ValueError):
        sync_multi(targets, TARGETS, master, SyncColumns("key", "match", ("v1", "v2")), **options)


def test_the_last_file_wins_in_reverse(spark):
    master = [(2, "K1", "M1", ""), (3, "K1", "M2", "keep-m2"), (4, "K1", "M1", "twin")]
    targets = [("a", 2, "K1", "M1", "from_a"), ("b", 2, "K1", "M1", "from_b")]
    assert cells(reverse(spark, master, targets), "row") == [("from_b", 1), ("keep-m2", 0), ("from_b", 1)]
    filled = reverse(spark, master, targets, fill_blank_only=True)
    assert cells(filled, "row") == [("from_b", 1), ("keep-m2", 0), ("twin", 0)]


def test_blank_targets_are_left_out_before_the_last_one_is_chosen(spark):
    targets = [("a", 2, "K", "M", "from_a"), ("b", 2, "K", "M", " ")]
    assert cells(reverse(spark, [(2, "K", "M", "old")], targets)) == [("from_a", 1)]
    assert cells(reverse(spark, [(2, "K", "M", "old")], targets, allow_blank_write=True)) == [(" ", 1)]


def test_written_by_file_keeps_files_without_a_write(spark):
    targets = [("t", 2, "K", "M", ""), ("u", 2, "Z", "M", "")]
    result = forward(spark, [(2, "K", "M", "V")], targets)
    assert rows(written_by_file(result, "file"), "file") == [("t", 1), ("u", 0)]


# --- random tables --------------------------------------------------------------------

TEXTS = [None, "", " ", "v", "w ", " "]
KEYS = [None, "", "K", " K", "L　", "a|b", "a"]
MATCHES = [None, " ", "M", "M ", "b|c", "c"]


def clean(value):
    return (value or "").strip()


def identity(key, match):
    return f"{clean(key)}|{clean(match)}" if clean(key) and clean(match) else None


def random_rows(rng, count, files=("f",)):
    return [
        (rng.choice(files), i, rng.choice(KEYS), rng.choice(MATCHES), rng.choice(TEXTS)) for i in range(count)
    ]


@pytest.mark.parametrize("fill", [False, True])
@pytest.mark.parametrize("allow", [False, True])
def test_random_tables_give_what_a_fold_gives(spark, fill, allow):
    rng = random.Random(17 + fill + 2 * allow)
    master = [r[1:] for r in random_rows(rng, 40)]
    targets = random_rows(rng, 120, ("a", "b", "c"))

    index = {}
    for _, key, match, value in master:
        if identity(key, match):
            index[identity(key, match)] = value or ""
    expected = []
    for file, row, key, match, old in sorted(targets, key=lambda r: (r[0], r[1])):
        new = index.get(identity(key, match))
        write = new is not None and (allow or clean(new)) and (not fill or not clean(old))
        expected.append((file, row, key, match, new if write else old, int(bool(write))))
    result = forward(spark, master, targets, fill_blank_only=fill, allow_blank_write=allow)
    assert result.columns[-1] == WRITTEN
    assert rows(result, "file", "row") == expected

    winners = {}
    for _, _, key, match, value in sorted(targets, key=lambda r: (r[0], r[1])):
        if identity(key, match) and (allow or clean(value)):
            winners[identity(key, match)] = value or ""
    expected = []
    for row, key, match, old in master:
        new = winners.get(identity(key, match))
        write = new is not None and (not fill or not clean(old))
        expected.append((row, key, match, new if write else old, int(write)))
    result = reverse(spark, master, targets, fill_blank_only=fill, allow_blank_write=allow)
    assert rows(result, "row") == expected


def test_layout_and_positions(spark):
    columns = ["id", "key", "match", "a", "b"]
    layout = resolve_layout(columns, "key", "match", last="a")
    assert layout.cells == ("id", "key", "match", "a")
    assert layout.content("combined_key") == ["id", "a"]
    assert layout.content("key_only") == ["id", "match", "a"]
    with pytest.raises(ValueError):
        resolve_layout(columns, "key", "match", last="key")
    df = spark.createDataFrame([(1, 2, 3)], "_row int, x int, y int")
    assert columns_at(df, 1, 2, ignore=["_row"]) == ["x", "y"]
    assert columns_at(df, 3, ignore=["_row"]) == []
    with pytest.raises(ValueError):
        columns_at(df, 0)
