import hashlib
import random
import re

import pytest
from lexiforge.llm import substrings as S
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def brute(docs, k=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least = {}
    for d, w in split:
        for i in range(len(w) - k + 1):
            if d is not None:
                x = tuple(w[i : i + k])
                least[x] = min(d, least.get(x, d))
    out = []
    for d, w in split:
        gone = {i + j for i in range(len(w) - k + 1) if d is not None and least[tuple(w[i : i + k])] < d for j in range(k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize("buckets", [1, 7])
def test_edge_cases(spark, buckets):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    docs = [
        (5, a), (3, a), (3, a), (3, b + " " + a), (9, b), (None, a), (None, b), (1, None), (2, ""), (7, "one two"), (8, "x " * 50_000), (4, "x\n" * 14),
        (11, a.replace(" ", "  \t") + " é " + a), (12, " ".join(a.split()[:13])), (13, " ".join(a.split()[:12])), (14, b + "\x85" + a), (15, "\x0b\x0c" + " ".join(b.split()[5:25])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as starts").repartition(3)
    assert result(S.deduplicated(df, buckets=buckets)) == brute(docs)


def test_random_small_words(spark):
    rng = random.Random(5)
    docs = [(rng.randrange(60), " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for _ in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(S.deduplicated(df, k=5, m=2, buckets=5)) == brute(docs, 5)


def test_empty(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_hashes_are_told_apart():
    import numpy as np

    word = np.arange(10, dtype=np.uint64)
    group, least = S.smallest(np.zeros(3, np.uint64), np.array([4, 2, 1]), np.array([0, 0, 5]), word, 3)
    assert least[group].tolist() == [2, 2, 1]


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in S.op10_substring_dedup(spark, DATA).collect()), key=str)
    assert got == brute(docs)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("hot", [0, 2000])
def test_hot_buckets_are_dealt_anew(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_BYTES", hot)
    monkeypatch.setattr(S, "HOT_PARTS", 7)
    rng = random.Random(6)
    common = " ".join(f"c{i}" for i in range(30))
    docs = [(rng.randrange(80), " ".join(rng.choice("abcdef") for _ in range(rng.randrange(80))) + " " + common * rng.randrange(2)) for _ in range(200)]
    docs += [(None, common), (100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(S.deduplicated(df, k=5, m=2, buckets=3)) == brute(docs, 5)
