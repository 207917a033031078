import random
import re
from collections import defaultdict

import regex
from llm_helpers import documents
from pyspark.sql import functions as F

from keyweave.llm import decontamination as d

ITEMS = "item_id bigint, text string"
QUESTION = (
    "Yesterday the baker Anna sold 12 loaves and 7 rolls, then Anna walked 5 km to the market "
    "and bought 12 eggs for the evening."
)


def plain_template(text):
    """Words, and their original forms."""
    text = text or ""
    named = regex.sub(r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}[\p{L}\p{N}]*", d.NAME, text)
    numbered = regex.sub(r"(?<![\p{L}\p{N}])\p{N}+(?![\p{L}\p{N}])", d.NUMBER, named)
    filled = regex.sub(rf"(?i)(?<={d.NUMBER} )(?:{'|'.join(d.UNITS)})(?![\p{{L}}\p{{N}}])", d.UNIT, numbered)
    between = rf"[^\p{{L}}\p{{N}}{''.join(d.SLOTS)}]+"
    return [w for w in regex.split(between, filled.lower()) if w], [w for w in regex.split(between, text) if w]


def plain_windows(words, size):
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def plain_matches(docs, items, size=5, least_words=3, share=0.5):
    """{position of a document: {smallest item of a group: share}} by comparing all with all.

    A group is a template with its equal slots; its share of template windows counts if it is large enough, else
    the greatest share of windows of the words of one of its items.
    """
    groups = defaultdict(set)
    for item_id, text in items:
        words, values = plain_template(text)
        slots = tuple(values.index(v) if w in d.SLOTS else None for w, v in zip(words, values, strict=True))
        groups[tuple(words), slots].add((item_id, text or ""))
    found = defaultdict(dict)
    for (words, slots), members in groups.items():
        item_id = min(member for member, _ in members)
        for at_doc, text in enumerate(docs):
            shares = [typed_share(words, slots, text, size, least_words)]
            shares += [max(share_as_it_is(own, text, size, least_words) for _, own in members)]
            reached = [s for s in shares if s >= share]
            if reached:
                found[at_doc][item_id] = round(reached[0], 9)
    return found


def typed_share(words, slots, text, size, least_words):
    least = min(least_words, len(words))
    windows = enumerate(plain_windows(list(words), size))
    places = [(i, w) for i, w in windows if sum(x not in d.SLOTS for x in w) >= least]
    dw, dv = plain_template(text)
    shifts = defaultdict(list)
    for at, w in enumerate(plain_windows(dw, size)):
        for place, wanted in places:
            if w == wanted:
                shifts[at - place].append((at, place))
    matched = set()
    for pairs in shifts.values():
        values = defaultdict(set)
        for at, place in pairs:
            for k in range(min(size, len(words))):
                if slots[place + k] is not None:
                    values[slots[place + k]].add(dv[at + k])
        if all(len(v) == 1 for v in values.values()):
            matched |= {place for _, place in pairs}
    return len(matched) / len(places) if places else 0.0


def share_as_it_is(item, text, size, least_words):
    own, of_doc = (plain_template(t.lower() if t else t)[1] for t in (item, text))
    if len(own) < least_words:
        return float(bool(own) and own == of_doc)
    n = min(size, len(own))
    held = set(plain_windows(of_doc, n)) if len(of_doc) >= n else set()
    windows = plain_windows(own, n)
    return sum(w in held for w in windows) / len(windows)


def test_templates_equal_the_plain_ones(spark):
    texts = [None, "", " .,", QUESTION, "5 km", "5km", "the Cat, a Dog. A bird", "ÉTÉ été Été, École", "x1 1x 3.14 kg", "№ ² 7"]
    docs = documents(spark, texts)
    rows = docs.select("doc_id", d.template(F.col("text")), d.originals(F.col("text"))).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        assert (row[1], row[2]) == plain_template(text)
        assert len(row[1]) == len(row[2])


def changed(text, pairs):
    return re.sub("|".join(map(re.escape, pairs)), lambda m: pairs[m[0]], text)


def test_reparameterised_questions_are_caught_and_mere_shapes_are_not(spark):
    same = changed(QUESTION, {"Anna": "Otto", "12": "31", "7": "8", "km": "miles"})
    shape = QUESTION.replace("12 eggs", "40 eggs").replace("then Anna", "then Berta")
    texts = [QUESTION, f"Some intro. {QUESTION} And more.", same, shape, "A clean text about bakers and the market."]
    bench = spark.createDataFrame([(3, QUESTION)], ITEMS)
    got = d.contamination_of_documents(documents(spark, texts), bench).orderBy("doc_id").collect()
    assert [r["contaminated"] for r in got[:3]] == [True] * 3
    assert got[3]["share"] < got[2]["share"] and not got[4]["contaminated"]


def test_matches_equal_comparing_all_with_all(spark):
    rng = random.Random(21)
    words = ["the", "of", "and", "river", "stone", "Anna", "Otto", "5", "12", "km", "kg", "blue", "runs", "é"]

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    items = [(i, text(rng.randrange(1, 30))) for i in range(25)]
    items += [(90, items[7][1].replace("Anna", "Otto")), (91, QUESTION), (92, None), (93, "")]
    docs = [None, "", "river"]
    for _ in range(60):
        source = rng.choice(items)[1] or ""
        kept = [w for w in source.split() if rng.random() > 0.05]
        docs.append(" ".join([text(rng.randrange(8)), *kept, text(rng.randrange(8))]).strip())
    docs += [changed(x, {"Anna": "Otto", "5": "9"}) for x in docs[3:20]] + [docs[5], text(9000)]
    table = documents(spark, docs).withColumns({"key": F.lit(1), "item_id": F.lit(2)})
    got = d.contamination_of_documents(table, spark.createDataFrame(items, ITEMS)).collect()
    want = plain_matches(docs, [(i, t) for i, t in items])
    assert len(got) == len(docs)
    for r in got:
        own = want.get(r["doc_id"], {})
        assert r["contaminated"] == bool(own) and r["n_classes"] == len(own), docs[r["doc_id"]]
        if own:
            assert r["item_id"] == min(own) and abs(r["share"] - max(own.values())) < 1e-6
    assert sum(r["contaminated"] for r in got) > 20


def test_large_tables_are_shuffled_to_the_same_result(spark):
    docs = documents(spark, [QUESTION, "clean", None, QUESTION + " x"])
    bench = spark.createDataFrame([(3, QUESTION), (4, "another one that nobody has")], ITEMS)
    small = d.Settings(most_broadcast=0)
    assert sorted(map(str, d.contamination_of_documents(docs, bench, small).collect())) == sorted(
        map(str, d.contamination_of_documents(docs, bench).collect())
    )


def test_leaks_go_and_the_rest_stays(spark):
    rows = [(1, QUESTION), (1, "clean text"), (2, None), (None, ""), (3, QUESTION), (4, "clean text"), (4, "clean text")]
    docs = documents(spark, rows).withColumn("class", F.lit("c"))
    got = d.decontaminated(docs, spark.createDataFrame([(0, QUESTION)], ITEMS))
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2", "4", "4", "None"]
    empty = spark.createDataFrame([], ITEMS)
    assert d.decontaminated(docs, empty).count() == len(rows)
    assert d.contamination_of_documents(docs.limit(0), empty).count() == 0


def test_plan_has_no_python(spark):
    bench = spark.createDataFrame([(0, QUESTION)], ITEMS)
    plan = d.contamination_of_documents(documents(spark, [QUESTION]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_items_without_template_windows_short_ones_and_other_case(spark):
    names = "Ask Anna Berta Carl Dora Emil Frida Gustav Hanna Ida who of them went to the old mill by the river"
    items = [(1, "Compute 12 + 7 - 9 * 4 + 15 - 3."), (2, names), (3, "What is gravity made of"), (4, "Name three moons"), (5, "12 + 7")]
    holding = ["Compute 12 + 7 - 9 * 4 + 15 - 3.", names.lower(), names.upper(), "He asked: name THREE moons, and left.", "12 + 7"]
    clean = ["Compute 13 + 8 - 1 * 2 + 16 - 5.", "three moons have a name", "in 12 7 of them", None]
    bench = spark.createDataFrame(items, ITEMS)
    got = d.contamination_of_documents(documents(spark, holding + clean), bench).orderBy("doc_id").collect()
    assert [r["item_id"] for r in got] == [1, 2, 2, 4, 5, None, None, None, None]
    assert {r["n_classes"] for r in got[:5]} == {1}
