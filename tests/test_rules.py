"""Lexicon rules, exemptions, menus and samples; collections; sessions of a stream."""

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import rules
from lexiforge.sources import files
from lexiforge.streaming import stateful

LEXICONS = {"cost": ("pain", "tired"), "joy": ("smile", "laugh"), "fight": ("sword",)}


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(expr(F.col("t")).alias("x"), "i").orderBy("i").collect()]


def test_hits(spark):
    texts = ["sword and smile", "pain, tired, smile", "", None, "nothing", "laugh smile pain tired sword"]
    assert column(spark, texts, lambda t: rules.first_hit(t, LEXICONS, "none")) == ["joy", "cost", "none", "none", "none", "cost"]
    assert column(spark, texts, lambda t: rules.all_hits(t, LEXICONS, default=["x"])) == [["joy", "fight"], ["cost", "joy"], ["x"], ["x"], ["x"], ["cost", "joy", "fight"]]
    assert column(spark, texts, lambda t: rules.all_hits(t, LEXICONS, least=2)) == [[], ["cost"], [], [], [], ["cost", "joy"]]
    assert column(spark, texts, lambda t: rules.all_hits(t, LEXICONS, limit=1))[5] == ["cost"]
    assert column(spark, texts, lambda t: rules.vote(t, LEXICONS, {"fight": F.lit(1.5)}, "none"))[:2] == ["fight", "cost"]


def test_confidence_and_length(spark):
    rows = [(100, 1.0, 10, 10.0), (50, 0.5, 5, 8.0), (0, 0.0, 0, 0.0), (10_000, 2.0, 100, 100.0)]
    df = spark.createDataFrame(rows, "f int, s double, k int, q double").select(rules.confidence(F.col("f"), F.col("s"), F.col("k"), F.col("q")).alias("c"))
    assert [round(r.c, 6) for r in df.collect()] == [1.0, 0.5, 0.0, 1.0]
    pairs = [("x" * 100, "x" * n) for n in (140, 130, 105, 100, 95, 80, 70, 60, 0)] + [("", "x"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select(rules.length_change(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == ["expanded", "adjusted", "kept", "kept", "kept", "adjusted", "adjusted", "condensed", "condensed", "kept", "condensed"]


def test_exemptions(spark):
    items = spark.createDataFrame([(1, ["tone", "pace"], ["a", "b"]), (2, ["tone"], []), (3, [], ["a"])], "id int, dims array<string>, subs array<string>")
    exempt = rules.exemptions(items, "id", "dims", "subs").withColumnRenamed("subs", "sub_item")
    exempt = exempt.toDF("id", "dimension", "sub_item")
    assert sorted(map(str, map(tuple, exempt.collect()))) == sorted(map(str, [(1, "tone", "a"), (1, "tone", "b"), (1, "pace", "a"), (1, "pace", "b"), (2, "tone", None)]))
    found = spark.createDataFrame([(1, "tone", "a"), (1, "tone", "c"), (2, "tone", "z"), (2, "pace", "a"), (3, "tone", "a")], "id int, dimension string, sub_item string")
    assert sorted(map(tuple, rules.not_exempt(found, exempt, "id").collect())) == [(1, "tone", "c"), (2, "pace", "a"), (3, "tone", "a")]


def test_menu_and_sample(spark):
    rows = [(2, "b", "Use LIGHT", 1, ["x"], "active"), (1, "b", "use dark", 2, ["y"], "active"), (3, "a", "light", 3, ["x", "y"], "active"), (4, "a", "light", 3, ["x"], "off"), (5, "c", None, 1, None, "active")]
    df = spark.createDataFrame(rows, "id int, category string, constraint_text string, intensity int, trigger_scene_types array<string>, status string")
    ids = lambda **k: [r.id for r in rules.menu(df, **k).collect()]
    assert ids() == [3, 1, 2, 5] and ids(scene="x") == [3, 2] and ids(word="Light") == [3, 2] and ids(scene="y", word="dark") == [1]
    with pytest.raises(ValueError, match="blank"):
        rules.menu(df, word=" ")
    many = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else "d") for i in range(31)], "id int, category string")
    first, again, other = (rules.sample_varied(many, "id", "category", 6, seed).collect() for seed in (1, 1, 2))
    assert first == again and first != other and len({r.category for r in first[:4]}) == 4 and len(first) == 6


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "id int, scene string, text string")
    files.write_collection(df, f"{tmp_path}/c", "scene")
    files.write_collection(df.where("id = 1"), f"{tmp_path}/c", "scene")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/c").select("id", "scene").collect()] == [(1, "x")]
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id int, text string")
    assert sorted((r.id, r.scene, r.text) for r in files.upsert(df, new, "id").collect()) == [(1, "x", "a"), (2, None, "z"), (3, None, "w")]


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 10:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-01-01 00:00:00"), (9, "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "u int, t string").selectExpr("u", "timestamp(t) as ts")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = stateful.sessions_stream(stream, "u", "ts").writeStream.format("memory").queryName("stream_sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.u, r.n, r.begin) for r in spark.table("stream_sessions").collect()}
    want = {(r.user, r.n, r.begin) for r in stateful.sessions(df.withColumnRenamed("u", "user"), "user", "ts").collect()}
    assert got <= want and len(got) >= 3
