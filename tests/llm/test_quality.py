import re
from collections import Counter

from lexiforge.llm import quality as Q
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    t = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(t)
    hit = {i + j for i, x in enumerate(t) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def columns(df):
    return {r[0]: tuple(r)[1:7] for r in df.collect()}


def test_statistics_on_edge_cases(spark):
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x", "a\x0bb\x85c d", "l one\n\nl one\nl one \n l one", "é#\U0001f600 $|<>" * 30, "the cat sat " * 9000, "a b c d a b c e b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("n_words", F.lit(2))
    out = df.select("doc_id", Q.judged(F.col("text"), []).alias("s")).select("doc_id", *[f"s.{x}" for x in (*Q.BASE, "base_failed")])
    assert columns(out) == {i: brute(t) for i, t in enumerate(texts)}


def test_whole_table_and_held_out_accuracy(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = Q.op6_quality_rules(spark, DATA).collect()
    assert {r[0]: tuple(r)[1:7] for r in got} == {i: brute(t) for i, t in docs.items()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in got}
    assert all(not kept[r.doc_id] for r in got if r.base_failed)
    # rules learned on half of the labels hold on the other half
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rules = Q.learn(spark.read.parquet(f"{DATA}/documents.parquet"), labels.where("doc_id % 2 = 0"))
    assert rules
    out = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", Q.judged(F.col("text"), rules)["kept"].alias("kept"), Q.judged(F.col("text"), rules)["base_failed"].alias("base")).where("doc_id % 2 = 1").collect()
    judged = [(good[r.doc_id], r.kept, r.base) for r in out if r.doc_id in good]
    assert sum(1 for g, k, b in judged if g == 1 and not k and not b) <= 0.02 * len(judged)
    bad = [k for g, k, _ in judged if g == 0]
    assert sum(not k for k in bad) >= 0.8 * len(bad)


def test_no_labels_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 10), (1, "w " * 10), (None, None)], "doc_id long, text string")
    assert Q.learn(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 0)], "doc_id long, quality int")
    assert Q.learn(docs, labels) == []
    assert Q.keep_good(docs, labels).count() == 0
    assert Q.keep_good(docs.limit(0), labels).count() == 0


def test_covering_prefers_precise_rules():
    edges = {x: [0.5] for x in Q.RATIOS}
    zero = (0,) * len(Q.RATIOS)
    bad = (0, 0, 1) + zero[3:]
    counts = [(bins, is_bad, prune, n) for bins, is_bad, n in ((bad, True, 40), (zero, False, 60)) for prune in (False, True)]
    rules = Q.cover(counts, edges)
    assert [str(c) for r in rules for c in r] == ["symbols > 0.5"]


def test_covering_goes_on_after_an_imprecise_rule():
    edges = {x: [0.5] for x in Q.RATIOS}
    at = lambda **on: tuple(int(x in on) for x in Q.RATIOS)
    # most bad rows have many digits, but so have many good ones; the others have many marks, and no good one has
    groups = [(at(digits=1), True, 90), (at(digits=1), False, 30), (at(marks=1), True, 20), (at(), False, 200)]
    counts = [(bins, is_bad, prune, n) for bins, is_bad, n in groups for prune in (False, True)]
    assert [str(c) for r in Q.cover(counts, edges) for c in r] == ["marks > 0.5"]


def test_verdict_is_the_ordered_list(spark):
    rules = [(Q.Condition("symbols", True, 0.1), Q.Condition("words", False, 60.0)), (Q.Condition("marks", True, 0.05),)]
    texts = ["# " * 55, "# " * 90, "wo! " * 70, "word " * 70, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", Q.judged(F.col("text"), rules).alias("s")).select("doc_id", "s.*")
    for r in df.collect():
        want = not r.base_failed and not (r.symbols > 0.1 and r.words <= 60) and not r.marks > 0.05
        assert r.kept == want, r
