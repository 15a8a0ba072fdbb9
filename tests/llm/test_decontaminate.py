import hashlib
import re

import pytest
from lexiforge.llm import decontaminate as D

DATA = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    known = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            known.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in known}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in known:
                    hit.update(range(i, i + k))
                    found |= known[x]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_items", [50_000, 3])
def test_edge_cases(spark, block_items):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "!!!"), (4, "Alpha, beta"), (None, "alpha beta " + long), (4, "Alpha, beta"), (5, long[20:]), (6, "é " + long.upper() + " ü" * 50), (7, "x " * 30_000 + long)]
    items = [(1, "ALPHA beta"), (2, None), (3, ""), (4, long), (4, long), (10, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (None, "x x x x x x x x x x")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' as key", "1 as n_words", "2 as items")
    got = D.contamination(docs_df, spark.createDataFrame(items, "item_id long, text string"), block_items=block_items)
    assert rows(got) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, items).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit) for r in D.contamination(some, items).collect()] == [(2, 0)]


def test_whole_table_against_brute_force(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(*c).collect()]
    got = D.op5_decontamination(spark, DATA)
    want = brute(read("documents", ["doc_id", "text"]), read("benchmark", ["item_id", "text"]))
    assert rows(got) == sorted(want, key=str)
    assert any(r[2] for r in want)


def test_clean_with_clashing_names(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"so {item} then", "a", 1), (2, "nothing of it", "b", 2), (None, None, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contaminated string, row int")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = D.clean(docs, benchmark)
    assert out.columns == docs.columns and sorted(r.contaminated for r in out.collect()) == ["b", "c"]
    assert D.clean(docs.limit(0), benchmark).collect() == [] and D.clean(docs, benchmark.limit(0)).count() == 3
