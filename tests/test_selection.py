"""Nulls, empties, ties and groups of their own for the selections."""

import pytest
from lexiforge.operators import selection as S
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "even"), ("", "even"), ("one.", "even"), ("abc. abd. abe.", "even"), ("a. abcd. abcdefgh.", "rising"), ("abcdefgh. abcd. a.", "falling"), ("ab. abcdefghijkl. ab.", "tight-loose-tight"),
        ("abcdefghijkl. ab. abcdefghijkl.", "loose-tight-loose"), ("a. abcdefghijkl. a. abcdefghijkl.", "abrupt"), ("abcdef. abcdefgh. abcdef. abcdefghij. abcdefg.", "breathing"),
    ],
)
def test_rhythm(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(S.rhythm(F.col("text")).alias("r")).head().r == want


def test_secondary_fills_only_a_short_primary(spark):
    rows = [(1, "p", 9.0, 1), (1, "p", 1.0, 2), (1, "s", 8.0, 3), (1, "s", 7.0, 4), (1, None, 99.0, 5), (2, "p", 5.0, 6), (2, "p", 5.0, 7), (2, "p", 5.0, 8), (2, "s", 9.0, 9), (3, "s", None, 10)]
    df = spark.createDataFrame(rows, "g int, kind string, score double, id int")
    got = S.primary_then_secondary(df, "g", "kind", "p", "s", "score", "id", 3, 2.0).orderBy("g", "rank").select("g", "id").collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, 3), (2, 6), (2, 7), (2, 8)]
    assert S.primary_then_secondary(df.limit(0), "g", "kind", "p", "s", "score", "id", 3, 2.0).count() == 0


def test_newest_of_any_kind_where_none_is_wanted(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, None), (2, 2, False)], "g int, t int, w boolean")
    got = S.recent_or_any(df, "g", ["t"], F.col("w"), 1).select("g", "t").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (2, 2)]


def test_polar_examples_leave_out_nulls(spark):
    df = spark.createDataFrame([(1, i, i % 2 == 0 if i < 9 else None) for i in range(12)], "g int, id int, good boolean")
    got = S.polar_examples(df, "g", F.col("good"), "id", "id", 3).collect()
    assert sorted((r.good, r.id) for r in got) == [(False, 7), (True, 4), (True, 6), (True, 8)]


def test_disagreements_count_rows_not_pairs(spark):
    df = spark.createDataFrame([("k", "a", i) for i in range(50)] + [("k", "b", 99), ("k", None, 100), ("l", "a", 101)], "k string, v string, id int")
    assert [tuple(r) for r in S.disagreements(df, "k", "v", "id").select("value_a", "first_a", "n_a", "value_b", "first_b", "n_b").collect()] == [("a", 0, 50, "b", 99, 1)]


def test_confidences(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "please go"), (3, "x" * 100 + " how please")], "id int, text string")
    got = {r.id: r.c for r in df.select("id", S.confidences(F.col("text"), {"please": 0.9, "how": 0.9}, 0.92, 0.02).alias("c")).collect()}
    assert got[0].unsure and got[0].intent is None and got[1].unsure and tuple(got[2]) == ("please", 0.95, False)
    assert got[3].intent == "how" and got[3].unsure


def test_agreement_places_and_descriptions(spark):
    df = spark.sql("select map('a', 1, 'b', null) as x, map('a', 1, 'b', null, 'c', 3) as y, map('z', 1) as z, cast(null as string) as s, 'one\ntwo hit\nthree' as t")
    r = df.select(S.agreement(F.col("x"), F.col("y")).alias("xy"), S.agreement(F.col("x"), F.col("z")).alias("xz"), S.described("<{s}|{t}>").alias("d"), S.located(F.col("t"), "hit").alias("l"), S.located(F.col("t"), "none", "end").alias("e"), S.located(F.col("s"), "hit").alias("n")).head()
    assert (r.xy, r.xz, r.d) == (1.0, None, "<|one\ntwo hit\nthree>")
    assert tuple(r.l) == (1, "middle") and tuple(r.e) == (2, "end") and tuple(r.n) == (0, "beginning")


def test_phases_and_audit(spark):
    df = spark.createDataFrame([(1, i, i % 3) for i in range(60)] + [(2, 0, 0)], "g int, t int, v int")
    assert sorted(tuple(r) for r in S.phases(df, ["g"], F.col("v") == 0).select("g", "n", "n_special", "n_normal", "phase").collect()) == [(1, 60, 20, 40, "growing"), (2, 1, 1, 0, "cold_start")]
    got = sorted(tuple(r) for r in S.recent_audit(df, "g", ["t"], 10, {"low": F.col("v") < 2, "zero": F.col("v") == 0}).collect())
    assert got == [(1, 10, 6, 3, "low"), (2, 1, 1, 1, "low,zero")]
    assert S.gated_candidates(df, "g", "v", 30).collect()[0][:3] == (1, 60, 0)
