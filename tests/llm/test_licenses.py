import random
import re
import time

import pytest
from lexiforge.llm import licenses as L
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as labels")
    return {r.doc_id: r._s for r in df.select("doc_id", L.scanned(F.col("text")).alias("_s")).collect()}


EDGE = [
    None, "", " ", "...", "MIT License", "mit license", "the MIT-License.", "permit license", "mit licenses", "MIT license MIT license", "cc by", "cc-by cc by cc", "CC BY-NC 4.0", "GNU General Public License GNU general public license, version 3",
    "\nApache\tLicense\x00mit\x7flicense", "éapache license", "apache licenseé", "K MİT license mit license", "word " * 30_000 + "cc by", "cc by " * 5_000, "gnu general public", "x" * 100_000,
]


def test_base_on_edge_cases(spark):
    got = scan(spark, EDGE)
    for i, text in enumerate(EDGE):
        assert tuple(got[i])[:5] == brute(text), repr((text or "")[:60])
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
        assert 0 <= got[i].score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2"), ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("Creative Commons Attribution-ShareAlike 3.0", "cc-by-sa-3.0"), ("3-Clause BSD license", "bsd,bsd-3"), ("BSD 3-Clause", "bsd-3"), ("the Mozilla Public License 1.1", "mpl-1.1"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this", "mit"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"), ("All rights reserved", "proprietary"), ("nothing of that kind, with an open mind", ""), ("You should have received a copy of the GNU General Public License along with this program", "gpl"),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"), ("You may convey verbatim copies of the Program's source code as you receive it", "gpl-3"),
        ("If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl-2"), ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "zlib"), ("die Freiheit, mit der er sun and rail", ""),
    ],
)
def test_labels(spark, text, labels):
    assert scan(spark, [text])[0].labels == labels


def test_keywords_are_needed():
    for label, pattern, keyword in L._SENTENCES:
        assert f" {keyword}" in " " + re.sub(r"\(\?:|\)\??", "", pattern.replace("[cs]e", "ce").replace("[cs]ee", "cee")), (label, keyword)
    assert len(L._SENTENCES) + len(L._SINGLE) >= 200 and [r.rank for r in L.RULES] == sorted(r.rank for r in L.RULES)
    for r in L.RULES:
        re.compile(r.pattern)


def test_containment(spark):
    ordered = [L.Rule("a", "one two three", "one", 0), L.Rule("b", "two three", "two", 1), L.Rule("c", "two three four", "two", 1), L.Rule("d", "three", "three", 0), L.Rule("e", "one two three", "one", 0)]
    df = spark.createDataFrame([("one two three four",)], "text string")
    found = df.select(L.detections(L.normalised(F.col("text")), ordered).alias("f")).head().f
    assert sorted((x.label, x.low, x.high) for x in found) == [("a", 0, 3), ("c", 1, 4)]


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = L.op4_license_scan(spark, DATA).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == {i: brute(t) for i, t in docs.items()}
    assert any(r.n_base for r in rows)
    assert all(bool(r.labels) == (r.score > 0) for r in rows)


def test_sweep_equals_comparing_all(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        hits = [(low, low + rng.randrange(1, 9), rng.choice((0, 1, 2)) * 1000 + rng.randrange(5), "x") for low in (rng.randrange(40) for _ in range(rng.randrange(1, 90)))]
        rows.append((i, hits))
    df = spark.createDataFrame(rows, f"id int, hits {L.FOUND}")
    got = {r.id: {tuple(x) for x in r.k} for r in df.select("id", L.uncontained(F.col("hits"), [0, 1, 2]).alias("k")).collect()}
    for i, hits in rows:
        beaten = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and (y[2] // 1000 <= x[2] // 1000 if y[1] - y[0] > x[1] - x[0] else y[2] < x[2])
        assert got[i] == {x for x in hits if not any(beaten(x, y) for y in hits)}


def test_dense_text_of_a_megabyte(spark):
    text = "Licensed under the Apache License, Version 2.0; see the MIT License. " * 15_000
    began = time.time()
    row = scan(spark, [text])[0]
    assert row.n_base == 30_000 and "apache-2" in row.labels.split(",") and time.time() - began < 120


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, "MIT License")], "doc_id long, text string")
    rows = docs.select("doc_id", L.scanned(F.col("text")).alias("_s")).collect()
    assert [r._s.base_labels for r in rows] == ["mit"] * 3 and len({r._s for r in rows}) == 1
    assert docs.limit(0).select(L.scanned(F.col("text")).alias("_s")).collect() == []
