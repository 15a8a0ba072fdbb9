"""JSON sources of all shapes."""

import hashlib
import json

from lexiforge.sources import records as R
from pyspark.sql import functions as F

DOCS = "id long, body string"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()[:16]


def made(spark, *docs):
    return spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d[0], ensure_ascii=False)) for i, d in enumerate(docs)], DOCS).selectExpr("*", "1 as position", "2 as item")


def test_listed(spark):
    df = made(spark, ({"items": [{"a": 1}, 5, {"b": {}}]},), ({"records": [{"c": 1}], "data": [{"d": 1}]},), ([{"e": 1}],), ({"other": [1]},), ("text",), None, "{broken", ({"items": {"x": 1}},), ({"data": []},), ({"items": [{"t": "y" * 2000}]},))
    got = {(r.id, r.position): r for r in R.listed_records(df.withColumnRenamed("id", "doc"), "doc", "body").withColumnRenamed("id", "rid").withColumnRenamed("doc", "id").collect()}
    assert {k: r.payload for k, r in got.items() if k[0] != 9} == {(0, 0): '{"a":1}', (0, 2): '{"b":{}}', (1, 0): '{"c":1}', (2, 0): '{"e":1}', (3, 0): '{"other":[1]}'}
    assert got[0, 0].rid == md5('{"a":1}') and len(got[9, 0].content) == 1000 and len(got[9, 0].payload) > 2000


def test_plain(spark):
    df = made(spark, ([{"content": "c"}, "s", 3, None, {"x": 1}],), ({"items": [1]},), (7,)).withColumnRenamed("id", "doc")
    got = sorted((r.doc, r.position, r.content, r.payload) for r in R.plain_records(df, "doc", "body").collect())
    assert got == [(0, 0, "c", '{"content":"c"}'), (0, 1, "s", '{"content":"s"}'), (0, 2, "3", '{"content":"3"}'), (0, 3, "null", '{"content":"null"}'), (0, 4, '{"x":1}', '{"x":1}'), (1, 0, '{"items":[1]}', '{"items":[1]}'), (2, 0, "7", '{"content":"7"}')]


def test_entities(spark):
    body = {"实体": {"甲.乙": {"类型": "角色", "描述": "述" * 600, "属性": {"b": "2", "a": 1, "空": ""}}, "丙": {}}}
    got = {r.name: r for r in R.entity_records(made(spark, (body,), ({},), None).withColumnRenamed("id", "doc"), "doc", "body").collect()}
    assert got["丙"].content == "【丙】\n类型: 未知" and got["丙"].description == "" and got["丙"].id == md5("丙")
    assert got["甲.乙"].content == "【甲.乙】\n类型: 角色\n描述: " + "述" * 600 + "\na: 1\nb: 2" and len(got["甲.乙"].description) == 500 and len(got) == 2


def test_payloads_texts_and_manifests(spark):
    item = {"name": "n", "short": [1, 2], "long": list(range(300)), "_embed_text": "old"}
    row = made(spark, (item,)).select(R.payload(F.parse_json("body"), F.lit("text")).alias("p")).head().p
    assert row == {"name": '"n"', "short": "[1,2]", "_embed_text": "text"}
    texts = spark.createDataFrame([("n", "d", ["e" * 400]), ("n", None, []), (None, "d", None), (None, "", ["e"]), ("x" * 600, "d", ["e"])], "name string, d string, ex array<string>")
    got = [r[0] for r in texts.select(R.embedded_text(F.col("name"), F.col("d"), F.col("ex"))).collect()]
    assert got == ["n\nd\n示例：" + "e" * 300, "n", "\nd", None, "x" * 500]
    files = spark.createDataFrame([("c", "a.json", b"1"), ("c", "b.json", b"2"), ("d", "a.json", b"1")], "collection string, path string, content binary")
    manifest = spark.createDataFrame([("c", hashlib.md5(b"1").hexdigest())], "collection string, file_hash string")
    assert sorted(r.path + r.collection for r in R.pending(files, manifest).collect()) == ["a.jsond", "b.jsonc"]
    assert R.pending(files, manifest, force=True).count() == 3
    docs = made(spark, ({"version": 1, "updated_at": 2},), ({"version": None},), ([],), None)
    got = {r.id: r.missing for r in R.missing_members(docs, "id", "body", ("version", "updated_at")).collect()}
    assert got == {1: ["updated_at"], 2: ["version", "updated_at"], 3: ["version", "updated_at"]}
