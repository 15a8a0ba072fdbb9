import random
import re
from collections import Counter
from itertools import pairwise
from zlib import crc32

import pytest

from lexiforge.llm import spelling as S
from lexiforge.llm.registry import SQL
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=2):
    form, out = {}, set()
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
        out.add((w, len(found)))
    rows = set()
    for w, n_near in out:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, counts[w], n_near, form[w], counts.get(form[w]), root))
    return rows


def result(df):
    rows = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("range_words", (7, 10**6))
def test_variants_equal_brute_force(spark, range_words):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(250)} | {"aaaaaa", "aaaaa", "aaaa", "𝒳bé", "𝒳b", "z" * 3000, "z" * 2999}
    counts = {w: rng.choice((3, 6, 6, 12, 30, 100)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "1 as place", "2 as root").repartition(3)
    assert result(S.variants(df, range_words=range_words)) == brute(counts)


def test_tables_have_files_for_their_words_not_for_partitions(spark, monkeypatch):
    """211 partitions that are not merged made 211 files of each table (check_h)."""
    made = []

    def write(self, df, name):
        out = whole_write(self, df, name)
        made.append((name, len(out.inputFiles())))
        return out

    whole_write = S.Scratch.write
    monkeypatch.setattr(S.Scratch, "write", write)
    counts = {a + b + "xyzu": 3 * 2 ** len(a) for a in ("", "a", "ab", "abc", "abcd") for b in ("e", "ef", "é", "ghi", "gh")}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = S.variants(df)
        assert out.rdd.getNumPartitions() <= 4
        assert result(out) == brute(counts)
        S.op13_spelling_variants(spark, DATA)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {name for name, _ in made} == {"words", "placed", "near", "known", "roots"}
    assert max(n for _, n in made) <= 4


def test_nodes_are_those_of_one_trie(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 10))) for _ in range(300)})
    rows = S.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), len(words), 11).collect()
    prefix = {}
    for r in rows:
        for i, node in enumerate(r.nodes):
            assert prefix.setdefault(node, r.word[:i]) == r.word[:i]
    assert len(prefix) == len({w[:i] for w in words for i in range(len(w) + 1)})
    assert [r.word for r in sorted(rows, key=lambda r: r.place)] == words


def test_roots_of_chains(spark):
    links = list(pairwise(range(30))) + [(i, 7) for i in range(100, 400)]
    got = {r.place: r.root for r in S.roots(spark.createDataFrame(links, "place long, to long")).collect()}
    assert got == {p: 29 for p, _ in links}
    assert S.roots(spark.createDataFrame([], "place long, to long")).collect() == []


def written(doc_id, run):
    h = crc32(f"{doc_id}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def test_words_are_counted_and_misspelt_by_rule(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("Hello", "hellO", "École", "ÉCOLE", "×÷été", "abc", "x1yyyyy", "naïve-naïve", "straße", "Ωmega", "longer_words")) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = [(rng.randrange(1000), t) for t in texts] + [(None, "naïve naïve naïve"), (5, None), (5, ""), (7, "q" * 200_000 + " " + "Word " * 50_000)]
    want = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            want[written("" if i is None else i, "".join(c.lower() if c < "\x80" else c for c in run))] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n").repartition(4)
    assert {r.word: r.n for r in S.word_counts(df).collect()} == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_empty(spark):
    assert S.variants(S.word_counts(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    assert result(S.variants(spark.createDataFrame([("alone", 3)], "word string, n long"))) == {("alone", 3, 0, None, None, "alone")}


def test_whole_table(spark):
    assert compare(S.op13_spelling_variants(spark, DATA), connect(DATA), SQL["op13_spelling_variants"]) is None
