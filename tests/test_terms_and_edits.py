"""Terms, edits and set overlap against plain loops and the standard library."""

import random
from difflib import SequenceMatcher

import pytest

from lexiforge.operators import overlap, terms, textdiff


def test_edits_equal_difflib():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("abé𝒳 ") for _ in range(rng.randrange(40)))
        b = "".join(rng.choice("abé𝒳 ") for _ in range(rng.randrange(40)))
        if rng.random() < 0.5:
            b = a[: len(a) // 2] + rng.choice(("", "x", "ab")) + a[len(a) // 2 + rng.randrange(3) :]
        codes = [(k, i, a[i:j], b[m:n]) for k, i, j, m, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if k != "equal"]
        assert textdiff.edits(a, b) == codes


def test_long_texts_and_nulls(spark):
    rng = random.Random(2)
    a = "".join(rng.choice("ab ") for _ in range(60_000))
    b = a[:20_000] + "NEW" + a[20_000:40_000] + a[40_010:]
    rows = [(1, a, b), (2, "x", None), (3, None, "x"), (4, "same", "same"), (5, "", "all"), (6, "all", "")]
    df = spark.createDataFrame(rows, "id long, old string, new string").selectExpr("*", "1 as _old", "2 as edits")
    got = {r.id: r.edits for r in textdiff.with_edits(df, "old", "new").collect()}
    assert [tuple(e) for e in got[1]][0] == ("insert", 20_000, "", "NEW") and len(got[1]) == 2 and got[1][1].kind == "delete"
    assert (got[2], got[3], got[4]) == (None, None, []) and [tuple(e) for e in got[5] + got[6]] == [("insert", 0, "", "all"), ("delete", 0, "all", "")]


def occurrences(text, term):
    return sum(text.startswith(term, i) for i in range(len(text)))


@pytest.mark.parametrize("block", (5, 200_000))
def test_terms_both_ways(spark, block, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_TERMS", block)
    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    names = [(i, made(rng.randrange(1, 8))) for i in range(60)] + [(100, "aa"), (101, "aa"), (102, ""), (103, None)]
    texts = [(i, made(rng.randrange(0, 30))) for i in range(150)] + [(500, None), (500, "aaaa"), (501, "a" * 100_000)]
    got = terms.containment(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(names, "term_id long, term string"), "term_id", "term").collect()
    want = [(d, t, occurrences(x, y), False) for d, x in texts if x for t, y in names if y and y in x]
    want += [(d, t, 0, True) for d, x in texts if x for t, y in names if y and x in y]
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_terms(spark):
    none = spark.createDataFrame([], "term_id long, term string")
    assert terms.containment(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text", none, "term_id", "term").collect() == []


def test_feedback_mapping(spark):
    patterns = [("slow pace", "rhythm", "pacing", ["cut", "vary"]), ("flat", "people", "voice", ["talk"]), ("slow", "rhythm", "speed", ["vary"])]
    rows = [(1, ["the slow pace drags", "so flat"], "x", "w"), (2, ["slow"], None, None), (3, ["unknown"], "battle", "w"), (4, [], "y", "w"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, points array<string>, scene string, writer string")
    got = {r.id: (r.dimension, r.category, r.suggestions, r.confidence) for r in terms.mapped_feedback(df, "id", "points", patterns, "scene", {"battle": ("action", "fight")}, "writer", {"w": ("style", "prose")}).collect()}
    assert got == {
        1: ("people", "voice", ["cut", "talk", "vary"], 0.8), 2: ("rhythm", "pacing", ["cut", "vary"], 0.8), 3: ("action", "fight", [], 0.6), 4: ("style", "prose", [], 0.5), 5: (None, None, [], 0.0),
    }


@pytest.mark.parametrize("part", (4, 512))
def test_overlap_equals_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(overlap, "_PART", part)
    rng = random.Random(4)
    made = lambda: [rng.choice("aaabcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(0, 9))]
    left, right = [(i, made()) for i in range(80)] + [(900, None)], [(i, made()) for i in range(90)] + [(901, ["a", None])]
    side = lambda rows, k: spark.createDataFrame(rows, f"{k} long, items array<string>")
    for share in (0.5, 0.8):
        got = overlap.overlapping(side(left, "forget"), "forget", side(right, "keep"), "keep", "items", share).collect()
        want = set()
        for i, a in left:
            for j, b in right:
                a_, b_ = set(a or ()) - {None}, set(b or ()) - {None}
                if a_ and b_ and len(a_ & b_) >= share * min(len(a_), len(b_)):
                    want.add((i, j, len(a_ & b_)))
        assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("few", "cells"), ((0, 1 << 20), (1000, 1 << 20), (1000, 200)))
def test_overlap_by_join_and_past_few_sets(spark, few, cells, monkeypatch):
    """Both ways give the same; where one side has few sets, the other one is not exploded into items and shuffled."""
    monkeypatch.setattr(overlap, "FEW_SETS", few)
    monkeypatch.setattr(overlap, "_CELLS", cells)
    rng = random.Random(6)
    made = lambda: [rng.choice(["the", "of", None, *map(str, range(30))]) for _ in range(rng.randrange(0, 12))]
    left, right = [(f"l{i}", made()) for i in range(50)] + [("x", None), (None, ["the"])], [(i, made()) for i in range(70)] + [(901, None), (None, ["of"])]
    one, two = spark.createDataFrame(left, "a string, items array<string>"), spark.createDataFrame(right, "b int, items array<string>").coalesce(1)
    plans, write = [], overlap.written
    monkeypatch.setattr(overlap, "written", lambda df, *x: (plans.append(df._jdf.queryExecution().toString()), write(df, *x))[1])
    got = overlap.overlapping(one, "a", two, "b", "items")
    assert got.dtypes == [("a", "string"), ("b", "int"), ("common", "bigint")] and len(plans) == (few > 0) and not any("Exchange hashpartitioning" in p for p in plans)
    want = set()
    for (i, p), (j, q) in ((x, y) for x in left for y in right if x[0] is not None and y[0] is not None):
        p_, q_ = set(p or ()) - {None}, set(q or ()) - {None}
        if p_ & q_ and len(p_ & q_) >= 0.5 * min(len(p_), len(q_)):
            want.add((i, j, len(p_ & q_)))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 20
    assert overlap.overlapping(one.limit(0), "a", two, "b", "items").collect() == []


def test_conflicts(spark):
    rows = [(1, 10, "ann", "low", "hill"), (1, 11, "ann", "high", "town"), (1, 11, "bob", "low", "town"), (1, 12, "bob", "low", None), (2, 20, "ann", "x", "hill"), (1, 13, "ann", None, "town"), (1, 10, "bob", "high", "hill"), (1, 11, None, "a", "b")]
    df = spark.createDataFrame(rows, "chapter long, id long, who string, state string, place string")
    got = sorted(map(tuple, overlap.state_conflicts(df, "chapter", "id", "who", "state").collect()))
    assert got == [(1, 10, 11, "ann", "low", "high"), (1, 10, 12, "bob", "high", "low")]
    got = sorted(map(tuple, overlap.place_conflicts(df, "chapter", "id", "who", "place").collect()))
    assert got == [(1, 10, 11, "hill", "town", ["ann", "bob"]), (1, 10, 13, "hill", "town", ["ann"])]
    texts = spark.createDataFrame([("use then pull",), ("pull then use",), ("use",), (None,)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in texts.select(overlap.used_before(F.col("t"), F.lit("use").cast("string"), F.lit("pull"))).collect()] == [True, False, False, None]
