from lexiforge.plans.retrieve import Collection, Request, preset, retrieve, retrieve_for_scene, search


def collections(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0], "x", "about rain"), (2, [0.9, 0.1], "y", "about wind"), (3, [0.0, 1.0], "x", None)], "id long, embedding array<double>, kind string, text string")
    b = spark.createDataFrame([(7, [0.5, 0.5], "z")], "key long, embedding array<double>, other string")
    return {"a": Collection(a, defaults={"text": "unknown"}), "b": Collection(b, key="key")}


def test_filters_before_and_after(spark):
    c = collections(spark)
    ask = Request([1.0, 0.0], ["a"], k=2)
    assert [r.id for r in search(c["a"], ask).orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in search(c["a"], preset({"q": ask}, "q", equal={"kind": "x"})).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in search(c["a"], preset({"q": ask}, "q", differs={"kind": "x"})).collect()] == [2]
    assert [r.id for r in search(c["a"], preset({"q": ask}, "q", contains={"text": "wind"})).collect()] == [2]
    assert [r.id for r in search(c["a"], preset({"q": ask}, "q", min_score=0.999)).collect()] == [1]
    assert search(c["a"], preset({"q": ask}, "q", equal={"none": 1})).count() == 0
    assert search(c["a"], preset({"q": ask}, "q", k=3)).where("id = 3").head().text == "unknown"


def test_fan_out(spark):
    c, ask = collections(spark), Request([1.0, 0.0], ["a", "b", "c"], k=2)
    assert sorted((r.source, r.id) for r in retrieve(c, ask).collect()) == [("a", 1), ("a", 2), ("b", 7)]
    assert sorted((r.source, r.id) for r in retrieve_for_scene(c, "battle", {"battle": ["b"]}, ask).collect()) == [("b", 7)]
