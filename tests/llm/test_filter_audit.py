import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from lexiforge.llm import filter_audit as A
from lexiforge.llm.registry import SQL
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def words(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fails(row, docs):
    text, ws = row[1] or "", words(row[1] or "")
    return {
        "A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in text for c in "#$%&*|"),
        "E": row[0] is not None and any(d[0] is not None and d[0] < row[0] and (d[1] or "") == text for d in docs),
    }


def brute(docs, labels):
    """The report by running every order of the filters over every document."""
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[i] == 1} for i in (1, 2))
    out, shapley = defaultdict(Counter), Counter()
    flags = [(d, d[2] or "", fails(d, docs)) for d in docs]
    for order in map("".join, permutations("ABCDE")):
        for d, part, f in flags:
            gone = False
            for step, x in enumerate(order, 1):
                cell = out[part, order, step]
                if f[x] and not gone:
                    cell["removed"] += 1
                    cell["good_lost"] += d[0] in good
                    cell["toxic_lost"] += d[0] in toxic
                    shapley[part, x] += 1
                elif f[x]:
                    cell["redundant"] += 1
                cell["unique_fails"] += f[x] and sum(f.values()) == 1
                gone |= f[x]
                cell["kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(*k, *(c[n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def rows(spark, docs, labels):
    docs = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as h", "2 as mask", "3 as part", "4 as cells").repartition(3)
    labels = spark.createDataFrame(labels, LABELS).selectExpr("*", "1 as good", "2 as part")
    out = A.report(A.mask_counts(docs, labels))
    return [tuple(r) for r in out.collect()]


def test_brute_force(spark):
    rng = random.Random(3)
    long = [" ".join(rng.choice(("w", "x")) + str(rng.randrange(90)) for _ in range(rng.choice((49, 50, 80)))) for _ in range(12)]
    texts = [*long, *(t + " A#" for t in long[:4]), *(t.upper() for t in long[:3]), "", None, "AB", "Á\x0bß x|", "a " * 60, long[0] + " ", "x" * 300_000]
    docs = [(i, rng.choice(texts), rng.choice(("s", "t", "", None))) for i in rng.sample(range(10**6), 150)]
    docs += [(None, long[1], "s"), (None, long[1], "s"), (-5, long[1], "t"), (-5, long[1], "s"), (-5, long[2], "s"), (2**40, long[1], None)]
    labels = [(d[0], rng.randrange(2), rng.choice((0, 1, None))) for d in docs[::2]] + [(-5, 1, 0), (-5, 0, 1), (None, 1, 1), (10**9, 1, 1)]
    got = rows(spark, docs, labels)
    assert len(got) == len(set(got)) == 3 * 600
    assert set(got) == brute(docs, labels)


def test_empty_tables(spark):
    assert rows(spark, [], []) == []
    got = rows(spark, [(1, None, None)], [])
    assert len(got) == 600 and {r[3] for r in got if r[1] == "BCDEA" and r[2] < 5} == {1} and {r[9] for r in got if r[1][r[2] - 1] == "A"} == {120}


def test_one_text_that_is_a_third_of_all(spark):
    docs = [(i, "same" if i % 3 == 0 else f"text {i}", "s") for i in range(3000)]
    got = {r[1]: r for r in rows(spark, docs, []) if r[2] == 1}
    assert got["EABCD"][4] == 999 and got["ABCDE"][4] == 3000


@pytest.mark.parametrize("tasks", (1, 70))
def test_sketch_never_clears_a_repeat(spark, tasks):
    rng = np.random.default_rng(5)
    once = rng.integers(-(2**63), 2**63, 4000)
    twice = rng.integers(-(2**63), 2**63, 500)
    values = [int(x) for x in (*once, *twice, *twice)]
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(tasks)
    before, A._ROWS = A._ROWS, 10
    try:
        sketch = A.counting_sketch(df, len(values))
    finally:
        A._ROWS = before
    may = lambda x: np.all([sketch[at] > 1 for at in A.slots_of(x, len(sketch))], axis=0)
    assert may(twice).all()
    assert may(once).mean() < 0.05


def test_full_sketch_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(A, "MAX_SLOTS", 1 << 16)
    monkeypatch.setattr(A, "SLOTS_PER_TEXT", 1)
    docs = [(i, f"text {i % 20_000}", "s") for i in range(30_000)]
    got = {r[1]: r for r in rows(spark, docs, []) if r[2] == 1}
    assert got["EABCD"][4] == 10_000


def test_whole_table(spark):
    assert compare(A.op12_filter_audit(spark, DATA), connect(DATA), SQL["op12_filter_audit"]) is None
