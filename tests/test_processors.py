"""Streams of rows out of order against the batch forms."""

import random
from datetime import datetime, timedelta

import pytest

from lexiforge.operators import validate
from lexiforge.streaming import processors, stateful

START = datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    processors.use_rocksdb(spark)
    yield spark
    spark.conf.set(name, before)


def run(spark, made, batches, schema, folder, build):
    """The rows of a stream that gets each batch as a file of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        for f in (folder / str(i)).glob("part-*.parquet"):
            (folder / "in").mkdir(exist_ok=True)
            f.rename(folder / "in" / f"{i:03}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = build(stream).writeStream.format("memory").queryName(made).outputMode("append").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(made).collect()


def test_out_of_order_rows(rocksdb, tmp_path):
    spark, rng = rocksdb, random.Random(1)
    rows = [(rng.choice((1, 1, 2)), START + timedelta(minutes=i), i, float(rng.randrange(9))) for i in range(60)]
    mixed = sorted(rows, key=lambda r: (r[2] + rng.randrange(15), r[2]))
    batches = [mixed[:20], mixed[20:40], mixed[40:], [(9, START + timedelta(days=3), 999, 0.0)]]
    schema = "user_id long, ts timestamp, event_id long, value double"
    df = spark.createDataFrame(rows, schema)
    got = run(spark, "ordered_windows", batches, schema, tmp_path, lambda s: processors.count_windows(s, "user_id", "ts", "event_id", "value", 5))
    want = {(r.user_id, r.window, r.n, r.total) for r in stateful.count_windows(df, "user_id", ["ts", "event_id"], "value", 5).collect()}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 5
    (tmp_path / "b").mkdir()
    got = run(spark, "ordered_falls", batches, schema, tmp_path / "b", lambda s: processors.regressions(s, "user_id", "ts", "event_id", "value"))
    want = {(r.user_id, r.event_id, r.before, r.value) for r in validate.regressions(df, "user_id", ["ts", "event_id"], "value").collect()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_files_that_change_and_go(rocksdb, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    seen = {"a": {m: "1" if m < 5 else "2" for m in range(0, 45, 5)}, "b": {0: "1", 5: "1", 40: "3"}, "c": {5: "1", 10: "1"}}
    scans = [[(p, seen[p][m], at(m)) for p in "abc" if m in seen[p]] for m in range(0, 45, 5)]
    got = run(rocksdb, "file_changes", scans, "path string, hash string, scanned timestamp", tmp_path, processors.file_changes)
    assert {(r.path, r.change) for r in got} >= {("a", "created"), ("b", "created"), ("c", "created"), ("a", "modified"), ("b", "deleted"), ("c", "deleted")}
    assert [r.change for r in sorted(got, key=lambda r: r.at) if r.path == "b"] == ["created", "deleted", "created"]
    assert sum(r.path == "a" for r in got) == 2
