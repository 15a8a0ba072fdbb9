"""JSON documents of any shape, against plain recursion."""

import json
import random

from lexiforge.operators import documents as D

OLD, KEY = "id long, body string", ["id"]


def name(key):
    return key.replace("\\", "\\\\").replace(".", "\\.")


def leaves(value, path=None):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves(v, name(k) if path is None else f"{path}.{name(k)}")]
    return [(path or "", value if isinstance(value, str) else None if value is None else json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False))]


def changes(a, b, path=None):
    below = lambda k: name(k) if path is None else f"{path}.{name(k)}"
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in a.keys() | b.keys():
            if k not in a:
                out.append((below(k), "added"))
            elif k not in b:
                out.append((below(k), "deleted"))
            elif json.dumps(a[k], sort_keys=True) != json.dumps(b[k], sort_keys=True):
                out += changes(a[k], b[k], below(k))
        return out
    return [(path or "", "modified")]


def made(rng, level=0):
    kind = rng.randrange(9 if level < 5 else 7)
    if kind >= 5:
        return {rng.choice(("a", "b", "a.b", "c\\d", 'q"{', "", "é")): made(rng, level + 1) for _ in range(rng.randrange(4))}
    return (rng.randrange(100), '{"b":1}', None, True, [1, {"x": {}}])[kind]


def test_leaves(spark):
    rng = random.Random(1)
    docs = [{"a": {}}, {"a": '{"b":1}'}, {"a.b": 1, "a": {"b": 2}}, {}, [1], "text", None, 'brace "{{" in \\ text', *({"k": made(rng)} for _ in range(200))]
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)] + [(-1, None), (-2, "{broken"), (-3, "")]
    got = D.flat_json(spark.createDataFrame(rows, OLD).selectExpr("*", "1 as path", "2 as value", "3 as _x"), KEY, "body").collect()
    want = [(i, *x) for i, d in enumerate(docs) for x in leaves(d)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fifty_levels(spark):
    deep = 7
    for i in reversed(range(50)):
        deep = {f"k{i}": deep, "side": "{" * 60}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"a":1}')], OLD)
    got = {(r.id, r.path, r.value) for r in D.flat_json(rows, KEY, "body").collect()}
    assert (1, ".".join(f"k{i}" for i in range(50)), "7") in got and (2, "a", "1") in got and len(got) == 52


def test_changes(spark):
    rng = random.Random(2)
    pairs = [(i, {"k": made(rng), "same": {"x": [1]}}, {"same": {"x": [1]}, "k": made(rng)}) for i in range(200)]
    pairs += [(900, {"a": {}}, {"a": {"b": 1}}), (901, {"a": {"b": 1}}, {"a": 1}), (902, {"a": 1}, {"a": "1"}), (903, {"a": None}, {}), (904, {"a": {"x": 1, "y": 2}}, {"a": {"y": 2, "x": 1}})]
    side = lambda n: spark.createDataFrame([(p[0], json.dumps(p[n])) for p in pairs], OLD)
    got = [(r.id, r.path, r.change) for r in D.json_changes(side(1), side(2), KEY, "body").collect()]
    assert sorted(got) == sorted((i, *x) for i, a, b in pairs for x in (changes(a, b) if json.dumps(a, sort_keys=True) != json.dumps(b, sort_keys=True) else []))


def test_changes_of_whole_rows(spark):
    a, b = ([(1, '{"a":1}'), (2, "{}"), (4, '{"b":2}')], [(1, '{"a":1}'), (3, '{"a":{"b":1}}'), (4, "[]")])
    got = D.json_changes(spark.createDataFrame(a, OLD), spark.createDataFrame(b, OLD), KEY, "body").collect()
    assert sorted(map(tuple, got)) == [(2, "", "deleted", "{}", None), (3, "", "added", None, '{"a":{"b":1}}'), (4, "", "modified", '{"b":2}', "[]")]
    empty = spark.createDataFrame([], OLD)
    assert D.json_changes(empty, empty, KEY, "body").collect() == [] and D.flat_json(empty, KEY, "body").collect() == []


def test_markdown_and_maps(spark):
    text = "# Part 1: Chapter 7 x\n| a | b |\n|---|:-:|\n| key | 1 |\n| key | 2 |\n| only |\n\n### One\nbody 1\n\n### Two\n"
    row = D.outline(spark.createDataFrame([("p", text), ("q", "no title"), ("r", "")], "path string, text string")).collect()
    assert row[0].chapter == "7" and row[0].settings == {"a": "b", "key": "2"} and [tuple(s) for s in row[0].scenes] == [("One", "body 1"), ("Two", "")]
    assert [(r.chapter, r.settings, r.scenes) for r in row[1:]] == [("?", {}, [])] * 2
    nodes = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, name string")
    edges = spark.createDataFrame([("x", "likes", "y"), ("x", "likes", "unknown"), (None, "likes", "y")], "src string, rel string, dst string")
    assert sorted(map(tuple, D.edges_by_name(edges, nodes).collect())) == [(1, "likes", 2), (1, "likes", 3)]
    entities = spark.createDataFrame([("1", "Ann", {"age": "3", "home": '{"city":"X","n":{}}'}), ("Bob", "Bob", {})], "id string, name string, attrs map<string,string>")
    got = sorted(map(tuple, D.settings_map(entities).collect()))
    assert got == sorted((n, f, v) for n in ("1", "Ann") for f, v in (("age", "3"), ("home", '{"city":"X","n":{}}'), ("home.city", "X"), ("home.n", "{}")))
