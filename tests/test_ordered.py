"""Rows before a row, with one group that has most rows, in few and in many ranges."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import dedup, ordered, validate
from lexiforge.plans import catalogue
from lexiforge.streaming import stateful
from tests.oracle import compare, connect

ROWS = "user_id long, ts timestamp, event_id long, value double"


def made():
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice((1, 1, 1, 2, 3, None)), start + timedelta(hours=rng.choice((0, 1, 30, 31, 90, 500)) + rng.randrange(60)), i, float(rng.randrange(9))) for i in range(600)]
    return rows + [(1, None, 9001, 2.0), (1, None, 9000, 1.0)]


@pytest.mark.parametrize("size", (7, 10**6))
def test_against_plain_loops(spark, size, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", size)
    rows = made()
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' as _by", "1 as _v").repartition(4)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.min, r[2])):
        groups.setdefault(r[0], []).append(r)
    want = {r[2]: (i, g[i - 2][2] if i > 1 else None) for g in groups.values() for i, r in enumerate(g, 1)}
    order = ["ts", "event_id"]
    got = ordered.with_number(ordered.with_row_before(df.drop("_by", "_v"), "user_id", order, ["event_id"]), "user_id", order, "i").collect()
    assert {r.event_id: (r.i, r._before.event_id if r._before else None) for r in got} == want and len(got) == len(rows)
    falls = {(g[i][2], g[i - 1][3]) for g in groups.values() for i in range(1, len(g)) if g[i][3] < g[i - 1][3]}
    assert {(r.event_id, r.before) for r in validate.regressions(df, "user_id", order, "value").collect()} == falls
    windows = {(u, w, sum(r[3] for r in g[10 * w : 10 * w + 10])) for u, g in groups.items() for w in range(len(g) // 10)}
    assert {(r.user_id, r.window, r.total) for r in stateful.count_windows(df, "user_id", order, "value").collect()} == windows
    sessions = set()
    for u, g in groups.items():
        times = [r[1] for r in g if r[1]]
        starts = [i for i in range(len(times)) if i == 0 or times[i] - times[i - 1] > timedelta(hours=24)]
        sessions |= {(u, n, b - a, times[a], times[b - 1]) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(times)], strict=True), 1)}
    assert {(r.user_id, r.session, r.n, r.begin, r.end) for r in stateful.sessions(df, "user_id", "ts").collect()} == sessions


def test_no_range_holds_a_group(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 1000)
    df = spark.range(30_000).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"))
    sizes = [r["count"] for r in ordered.ranged(df, ["event_id"]).groupBy("user_id", "__range").count().collect()]
    assert max(sizes) < 3000 and sum(sizes) == 30_000


@pytest.mark.parametrize("zone", ("UTC", "America/New_York"))
def test_times_without_a_zone(spark, zone, monkeypatch):
    """As in the event tables; in New York clocks went back on 3 November 2024, so that 1:30 came twice."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 10)
    times = [datetime(2024, 11, 3) + timedelta(minutes=3, microseconds=7) * i for i in range(100)] + [datetime(2024, 3, 10) + timedelta(minutes=3) * i for i in range(100)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(1, t, i, 0.0) for i, t in enumerate(times)] + [(1, None, 999, 0.0)], ROWS.replace("timestamp", "timestamp_ntz"))
        got = ordered.with_number(ordered.with_row_before(df, "user_id", ["ts", "event_id"], ["event_id"]), "user_id", ["ts", "event_id"], "i")
        got = {r.event_id: (r.i, r._before.event_id if r._before else None) for r in got.collect()}
        days = ordered.ranged(df.withColumn("ts", F.col("ts").cast("date")), ["ts"]).select("__range").distinct().count()
        n = stateful.sessions(df, "user_id", "ts").collect(), stateful.count_windows(df, "user_id", ["ts", "event_id"], "value").count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    order = [999, *sorted(range(200), key=times.__getitem__)]
    assert got == {e: (i + 1, order[i - 1] if i else None) for i, e in enumerate(order)}
    assert days > 1 and sorted(r.n for r in n[0]) == [100, 100] and n[1] == 20


@pytest.mark.parametrize("name", ("audit_count_windows", "json_snapshot_diff", "regressions", "session_timeout"))
def test_queries_equal_their_sql_over_many_ranges(spark, name, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    sf_dir = "/root/testdata/sf0.001"
    assert compare(catalogue.QUERIES[name](spark, sf_dir), connect(sf_dir), catalogue.SQL[name]) is None


def test_empty_tables(spark):
    df = spark.createDataFrame([], ROWS)
    assert stateful.count_windows(df, "user_id", ["ts"], "value").collect() == [] and stateful.sessions(df, "user_id", "ts").collect() == []


@pytest.mark.parametrize("copies", (3, 10_000))
def test_exact_duplicates_with_one_common_text(spark, copies, monkeypatch):
    monkeypatch.setattr(dedup, "_COPIES", copies)
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 5}") for i in range(200, 0, -1)] + [(500, None), (501, None), (502, "")]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    got = {r.doc_id: r.first_id for r in dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if t is None else first[t] for i, t in rows}
