import base64
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from lexiforge.llm import warc as A
from lexiforge.llm.common import materialise, shared_path
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def brute(pages):
    keep = {}
    for p, _, h in pages:
        h = h or ""
        keep[h] = p if keep.get(h) is None else keep[h] if p is None else max(p, keep[h])
    out = []
    for p, _, h in pages:
        raw, last = (h or "").encode(), keep[h or ""]
        again = last is not None and (p is None or p < last)
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def there_and_back(spark, df, **more):
    path = shared_path(spark, "test")
    A.write(df, path, **more)
    return materialise(A.runs(spark, path), "test")


def test_edge_cases(spark):
    rng = random.Random(3)
    pages = [
        (1, "http://a.example/x", None), (2, "http://a.example/x", ""), (3, None, "é\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u\r\nContent-Length: 1", "twice"), (-4, "", "twice"), (5, "HTTP://WWW.B.example:80/?b=2&a=1#f", "twice"),
        (5, "HTTP://WWW.B.example:80/?b=2&a=1#f", "twice"), (6, "x", "y" * 500_000), (None, "z", "alone"), (7, "q", "\x00\x01 \n\r"), (2**62, "q", "\r\n"),
    ]
    pages += [(100 + i, "https://hot.example/page", f"<p>{rng.randrange(40)}") for i in range(300)]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as keep").repartition(4)
    found = there_and_back(spark, df, file_records=20)
    assert found.count() >= 16
    merged = A.histories(found, range_captures=64)
    assert result(merged) == brute(pages)
    rows = merged.orderBy("range", "place").collect()
    keys = [r.key for r in rows]
    assert keys == sorted(keys) and merged.select("range").distinct().count() > 2
    assert [r.position for r in rows] == list(range(len(pages)))


def test_archives_are_bounded_by_bytes(spark):
    pages = [(i, f"http://a.example/{i}", "ab"[i % 2] * (n + i)) for i, n in enumerate([10] * 50 + [3_000] * 20 + [90_000] * 5 + [4_000_000])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = shared_path(spark, "test")
    A.write(df, path, file_records=100, file_bytes=10_000)
    found = materialise(A.runs(spark, path), "test")
    sizes = [r.captures for r in found.collect()]
    assert all(len(s) == 1 or sum(c.payload_bytes for c in s) <= 10_000 for s in sizes)
    assert result(A.histories(found)) == brute(pages)


def test_few_ranges_where_captures_are_many(spark, monkeypatch):
    monkeypatch.setattr(A, "MAX_RANGES", 3)
    pages = [(i, f"http://a.example/{i % 97}", f"p{i}") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    merged = A.histories(there_and_back(spark, df, file_records=20), range_captures=8).collect()
    assert len({r.range for r in merged}) <= 5 and len(merged) == 400


def test_empty(spark):
    found = there_and_back(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert A.histories(found).collect() == []


def test_small_payloads_can_stay(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert [t for *_, t, _ in result(A.histories(there_and_back(spark, pages, least_bytes=3)))] == ["response", "response", "revisit", "response"]


@given(st.lists(st.lists(st.integers(0, 9), max_size=8), max_size=9))
def test_loser_tree(lists):
    rows = [sorted((x, i, j) for j, x in enumerate(s)) for i, s in enumerate(lists)]
    assert list(A.LoserTree(rows)) == sorted(r for s in rows for r in s)


def test_url_keys():
    assert A.url_key("HTTP://WWW.B.Example:80/?b=2&a=1#f") == "example,b)/?a=1&b=2"
    assert A.url_key("https://u@m.x.org:8080/a/b") == "org,x,m:8080)/a/b" and A.url_key("") == ")/"


@pytest.mark.parametrize("text", ["", "abc", "é" * 100])
def test_digest(spark, text):
    got = spark.range(1).select(A.base32_sha1(F.lit(text)).alias("d")).head().d
    assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_whole_table(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(A.op1_warc_histories(spark, DATA)) == brute(pages)
