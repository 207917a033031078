import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from keyweave.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["", "\\", "<|", "<|turn|>", "<|end|>\n", "<|more|>", "\\<|text|>", "a\nb", "</turn> ok", None, "<\\|", "é😀", "$1"]


def plain_rows(rows):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in of.items():
        turns.sort()
        listing = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        yield (
            conv,
            len(turns),
            hashlib.sha256(listing.encode()).hexdigest(),
            len(learned),
            hashlib.sha256(learned.encode()).hexdigest(),
        )


def some_rows():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|x"]), rng.choice(NASTY) )
            for c in (*range(40), None) for t in range(rng.randrange(1, 9))]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, None, "assistant", "first"), (50, 1, "user", "a")]
    return [*rows, (51, 0, "assistant", "long " * 40_000)]


def test_what_is_read_back_is_what_was_given(spark):
    rows = some_rows()
    got = chat.digests(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    want = {r[0]: r for r in plain_rows([*rows, *chat.ADDED])}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[:5] == want[r["conv_id"]]


def test_turns_of_one_role_are_one_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    row = chat.formatted(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["formatted"] == (
        "<|turn|>user<|text|>a<|more|>b<|end|>\n<|turn|>assistant<|text|>c<|end|>\n<|turn|>user<|text|>d<|end|>\n"
    )
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["c"]


def test_added_conversation_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.formatted(empty).count() == 0
    (row,) = chat.digests(spark, empty.withColumn("segments", F.lit(1))).collect()
    text = r"\### Assistant: </turn> ok"
    assert (row["conv_id"], row["n_turns"], row["loss_chars"]) == (-7, 2, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_plan_has_no_python(spark):
    plan = chat.digests(spark, spark.createDataFrame(some_rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
