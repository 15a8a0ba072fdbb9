import random
import re

import pytest
from lexiforge.llm import jaccard as J
from lexiforge.llm.components import components

DATA = "/root/testdata/sf0.01"


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        if docs[i][0] is None:
            continue
        for j in {j for x in s for j in index[x] if j < i and docs[j][0] is not None}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "percent", "orders"), [(3, 90, 3), (5, 80, 2), (2, 60, 1)])
def test_near_copies_chains_and_edge_cases(spark, k, percent, orders):
    rng = random.Random(k)
    docs = [(90, None), (91, ""), (92, " \n"), (93, "One"), (94, "one"), (95, "one two"), (96, "one two "), (None, "one"), (None, None), (97, "ÉA b c d"), (98, "éa b c d"), (98, "éa b c d"), (89, "x " * 40_000)]
    for g in range(8):
        base = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice((8, 40, 120))))
        docs += [(1000 * g + rng.randrange(10**6), near(rng, base, rng.randrange(0, 8))) for _ in range(25)]
        if g % 2:
            docs.append((10**7 + g, base))
        chain = base
        for _ in range(10):
            chain = near(rng, chain, 1)
            docs.append((rng.randrange(10**6), chain))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as node").repartition(5)
    assert result(J.linked_components(df, k, percent, orders)) == brute(docs, k, percent)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.linked_components(docs).collect() == []
    assert J.one_of_each(docs).collect() == []


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [
        (7, text, "a"), (3, text + " x", "b"), (3, text + " x", "b2"), (9, "other words", "c"), (None, text, "d"), (10, None, "e"), (11, None, "f"),
        (None, other, "g"), (None, other + " y", "h"), (None, other, "i"), (1, "one two", "j"), (1, "one two", "k"), (None, "one two", "l"),
    ]
    out = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    assert out.columns == ["doc_id", "text", "node"]
    kept = sorted(r.node for r in out.collect())
    assert [kept.count(x) for x in "cef"] == [1, 1, 1]
    assert [len(set(kept) & set(group)) for group in (("a", "b", "b2", "d"), ("g", "h", "i"), ("j", "k", "l"))] == [1, 1, 1] and len(kept) == 6
    assert {"b", "b2"} & set(kept) and {"j", "k"} & set(kept)


def test_a_leader_of_many_is_dealt_to_parts(spark):
    """One group of near copies that is most of the table: links are found, and no key of a join has all its rows."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:j] + [f"n{i}"] + base[j + 1 :])) for i in range(1, 700) for j in [rng.randrange(200)]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.component_id for r in J.linked_components(df).collect()} == {1}
    tables = J.Scratch(spark)
    pairs = tables.write(spark.createDataFrame([(i, 0) for i in range(1, 700)] + [(5000, 5001)], "x long, y long"), "pairs")
    used, ends, dealt = J._dealt(tables, pairs)
    most = dealt.groupBy("y", "part_y").count().agg({"count": "max"}).head()[0]
    assert most < 3 * J._PARTNERS and dealt.count() == 700
    assert {(r.y, r.part_y) for r in dealt.collect()} <= {(r.node, r.part) for r in ends.collect()}


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    names = rng.sample(range(10**6), 200)
    links = [(names[i], names[i + 1]) for i in range(199) if i not in (49, 120)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    groups = [names[:50], names[50:121], names[121:]]
    assert set(got) == set(names)
    assert [len({got[x] for x in g}) for g in groups] == [1, 1, 1] and len(set(got.values())) == 3


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert result(J.op2_ngram_jaccard_join(spark, DATA)) == brute(docs, 3, 90)
