"""Hand cases for operators that the registered queries do not reach, or reach on plain rows only."""

import io
import random
import zipfile

import pytest
from lexiforge.functions import text as T
from lexiforge.operators import classify, dedup, discover, evaluate, retrieval, rollups, validate
from lexiforge.profiles import CJK, LATIN, Scene
from lexiforge.sources import files
from lexiforge.streaming import stateful
from pyspark.sql import functions as F


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression.alias("x")).head().x


@pytest.mark.parametrize(
    ("text", "ad", "catalog", "ends"),
    [("Visit HTTP://x.y now", True, False, False), ("Chapter 1\n\nchapter ii\nbody", False, True, False), ("It ended. \n", False, False, True), ("", False, False, False)],
)
def test_filters(spark, text, ad, catalog, ends):
    t = F.col("text")
    assert one(spark, text, F.struct(T.is_ad(t, LATIN), T.is_catalog(t, LATIN), T.ends_sentence(t, LATIN))) == (ad, catalog, ends)


def test_statistics(spark):
    t = F.col("text")
    assert one(spark, "", T.script_ratio(t, CJK.script)) == 0.0
    assert one(spark, "血牙ab", T.script_ratio(t, CJK.script)) == 0.5
    assert one(spark, "abab abab abab", T.pair_statistics(t)["density"]) == pytest.approx(2 / 11)
    assert one(spark, "ab" * 20, T.pair_statistics(t)["entropy"]) == pytest.approx(1.0, abs=0.01)
    assert one(spark, "short", T.pair_statistics(t)["entropy"]) == 0.0
    assert one(spark, "x\nok line\n www.a.b \n  two  ", T.clean_lines(t, LATIN)) == "ok line\ntwo"
    assert one(spark, None, T.quality_score(t, F.lit(1), F.lit(1.0), LATIN)) is None
    assert one(spark, "", T.stylometrics(t, LATIN)).n_sentences == 0


def test_intents_and_genres(spark):
    assert one(spark, " the the the ", classify.genre(F.col("text"), LATIN)) == "unknown"
    assert one(spark, " der und and the und die ", classify.genre(F.col("text"), LATIN)) in ("german", "unknown")
    turns = spark.createDataFrame([(1, "please explain?"), (2, None), (3, "zzz")], "id long, text string")
    out = {r.id: (r.intent, r.ambiguous) for r in classify.intents(turns, [("q", r"\?", 0), ("r", "please", 0)], ["id"]).collect()}
    assert out[1] == ("q", True) and out[2][0] == "none" and out[3][0] == "none"


def test_boundary(spark):
    rows = [(1, i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)]
    got = {r.i: r.delta for r in classify.boundary_delta(spark.createDataFrame(rows, "d long, i long, v array<double>"), "d", "i", "v").collect()}
    assert got[0] == 1.0 and got[3] == pytest.approx(1.0) and got[1] < 0.5


def test_knn_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(300)] + [(900, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.knn(df, df.where("vec_id % 50 = 0"), 5, group="label").collect()}
    import numpy as np

    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v}
    for q in range(0, 300, 50):
        score = lambda i: round(float(vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i])), 6)  # noqa: B023, E731
        best = sorted((i for i in vectors if i != q and i % 3 == q % 3), key=lambda i: (-score(i), i))[:5]
        assert [got[q, r] for r in range(1, 6)] == best
    assert retrieval.knn(df, df.limit(0), 5).count() == 0


def test_rerank_keeps_short_lists(spark):
    rows = [(1, 10, 0.1, [[1.0, 0.0]], [[0.0, 1.0]]), (1, 11, 0.2, [[1.0, 0.0]], [[1.0, 0.0], [0.5, 0.5]]), (1, 12, 0.3, [[1.0, 0.0]], [[0.5, 0.5]]), (2, 13, 0.4, [[1.0, 0.0]], [[0.0, 1.0]])]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, q array<array<double>>, d array<array<double>>")
    out = [(r.query_id, r.id, r.score_kind) for r in retrieval.rerank(df, "q", "d", "id", 2).orderBy("query_id", "rank").collect()]
    assert out == [(1, 11, "late"), (1, 12, "late"), (2, 13, "first")]


def test_fuse(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, id long, rank long")
    b = spark.createDataFrame([(1, 6, 1)], "query_id long, id long, rank long")
    top = retrieval.fuse([a, b], "id", 2).orderBy("rank").collect()
    assert [r.id for r in top] == [6, 5] and top[0].score == pytest.approx(1 / 61 + 1 / 60, abs=1e-8)


def test_greedy_is_not_components(spark):
    items = spark.range(6).withColumnRenamed("id", "doc_id")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "x long, y long")
    kept = {r.doc_id: r.kept for r in dedup.greedy(items, pairs).collect()}
    assert kept == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from here " * 3
    docs = spark.createDataFrame([(1, base), (2, base + "x"), (3, "something else entirely, nothing alike at all in this text"), (4, ""), (5, None)], "doc_id long, text string")
    assert [tuple(r) for r in dedup.near_duplicates(docs).collect()] == [(1, 2)]


def test_near_families_against_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for _ in range(3):
        family = [[rng.choice("abcdefghij klmnop") for _ in range(400)]]
        while len(family) < 25:
            text = list(rng.choice(family))
            for at in rng.sample(range(400), rng.randint(0, 10)):
                text[at] = rng.choice("uvwxyz")
            family.append(text)
        docs += ["".join(t) for t in family]
    rng.shuffle(docs)
    docs += docs[:5]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in docs]
    kept = []
    for i, s in enumerate(sets):
        if not any(len(s & sets[k]) >= 0.85 * len(s | sets[k]) for k in kept):
            kept.append(i)
    items = [*enumerate(docs), (900, ""), (901, None), (None, docs[0])]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.kept for r in dedup.greedy_near(df, rows=1).collect()}  # families share buckets
    assert set(out) == {r[0] for r in items} and 3 < len(kept) < 70
    assert {d for d, stays in out.items() if stays} == {*kept, 900, 901, None}


def test_recall_of_bands():
    """Of pairs at a similarity of 0.85 or more, made by edits of random texts, nine in ten share a bucket."""
    rng = random.Random(9)
    near = found = 0
    for _ in range(400):
        base = [rng.choice("abcdefghij klmnop") for _ in range(300)]
        other = list(base)
        for at in rng.sample(range(300), rng.randint(1, 6)):
            other[at] = rng.choice("uvwxyz")
        x, y = (dedup.shingles("".join(t)) for t in (base, other))
        common = len(set(x.tolist()) & set(y.tolist()))
        if common < 0.85 * (len(x) + len(y) - common):
            continue
        a, b = (dedup.signature(t).reshape(16, 8) for t in (x, y))
        near += 1
        found += bool((a == b).all(axis=1).any())
    assert near > 150 and found >= 0.9 * near


def test_shingles_are_distinct_windows():
    for text in ("", "abc", "abcde", "abcdeabcde", "\U0001f600é漢x" * 9):
        windows = {text[i : i + 5] for i in range(len(text) - 4)} or ({text} if text else set())
        assert len(dedup.shingles(text)) == len(windows)
    assert len(dedup.shingles(None)) == 0


def test_keyword_clusters(spark):
    assert one(spark, "Bee ant the bee, cat x ant bee dog eel", discover.top_words(F.col("text"), "[a-z]+", ("the",), 4)) == ["bee", "ant", "cat", "dog"]
    texts = [("sail wind other sail",)] * 3 + [("sail rope",), ("rope sail",), ("wind mast",)] + [("",), (None,)]
    df = spark.createDataFrame(texts, "text string")
    found = {r.name: (r.keywords, r.n) for r in discover.keyword_clusters(df, "[a-z]+", ("other",), least=2).collect()}
    assert found == {"sail wind": (["sail", "wind"], 3), "rope sail": (["rope", "sail"], 2)}
    sea = (Scene("sea", ("sail",)),)
    assert [tuple(r) for r in discover.keyword_clusters(df, "[a-z]+", ("other",), sea, least=2).collect()] == [("sea", ["rope", "sail", "wind"], 5)]


def test_evaluation(spark):
    ranked = spark.createDataFrame([("a", 1, 0), ("a", 2, 2), ("b", 1, None)], "query_id string, rank long, relevance int")
    out = {r.query_id: r for r in evaluate.scores(ranked, 5, expected=spark.createDataFrame([("a", 4)], "query_id string, n_relevant long")).collect()}
    assert out["a"].ndcg == pytest.approx(0.6309, abs=1e-4) and out["a"].precision == 0.2 and out["a"].recall == 0.25
    assert out["b"].ndcg is None and out["b"].recall == 1.0


def test_validation(spark):
    names = spark.createDataFrame([("ab",), ("abc",), ("x",)], "name string")
    items = spark.createDataFrame([("abcd",), ("abx",), ("q",), (None,)], "text string")
    assert {r.text: r.name for r in validate.longest_prefix(items, "text", names, "name").collect()} == {"abcd": "abc", "abx": "ab", "q": None, None: None}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, h string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, h string")
    assert sorted((r.k, r.change) for r in validate.changes(old, new, "k", "h").collect()) == [(1, "deleted"), (2, "modified"), (3, "created")]
    assert one(spark, "x", rollups.rating(F.lit(44.0))) == "A"


def test_readers(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("a.xhtml", "<p>One &amp; two</p>")
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"\xef\xbb\xbfplain", "b.txt": "中文".encode("gb18030"), "c.epub": book.getvalue(), "d.docx": b"broken", "sub/e.md": b"# T\n\n## One\nbody\n\n## Two\n"}.items():
        (tmp_path / name).write_bytes(data)
    read = files.texts(files.scan(spark, str(tmp_path)))
    found = {r.path.rsplit("/", 1)[1]: r.text for r in read.collect()}
    assert found == {"a.txt": "plain", "b.txt": "中文", "c.epub": "One & two", "d.docx": None, "e.md": "# T\n\n## One\nbody\n\n## Two\n"}
    assert files.failures(read).count() == 1
    parts = files.markdown_sections(read.where("kind = 'md'")).orderBy("index").collect()
    assert [(r.title, r.body) for r in parts] == [("One", "body"), ("Two", "")]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sorted(tuple(r) for r in files.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", i % 3, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, at string, user_id long, value double").selectExpr("event_id", "cast(at as timestamp) as ts", "user_id", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    _run(stateful.count_windows_stream(source(), "user_id", "value"), "windows")
    want = {(r.user_id, r.window, r.total) for r in stateful.count_windows(df, "user_id", ["event_id"], "value").collect()}
    assert {(r.user_id, r.window, r.total) for r in spark.table("windows").collect()} == want
    _run(stateful.tumbling(source(), "ts", "user_id", "value", "1 hour", late="10 minutes"), "hours", "complete")
    want = {tuple(r) for r in stateful.tumbling(df, "ts", "user_id", "value", "1 hour").collect()}
    assert {tuple(r) for r in spark.table("hours").collect()} == want


def test_file_states(spark):
    kind = "path string, modified long, size long, hash string"
    before, now = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "z")], kind), spark.createDataFrame([("a", 2, 1, "x"), ("b", 1, 1, "y"), ("d", 1, 1, "q")], kind)
    assert sorted(tuple(r) for r in stateful.file_states(now, before).collect()) == [("a", "modified"), ("c", "deleted"), ("d", "created")]
    assert sorted(tuple(r) for r in stateful.file_states(now, before, verify_hash=True).collect()) == [("c", "deleted"), ("d", "created")]


def test_signatures_equal_their_definition_and_take_less_time():
    import time

    import numpy as np

    rng = random.Random(3)
    mix = lambda x: dedup._mix(np.array([x % 2**64], np.uint64))[0]
    one = lambda t, i: min((int(x) * (int(dedup._STEPS[2 * i]) | 1) + int(dedup._STEPS[2 * i + 1])) % 2**64 for x in t)
    for n in (0, 1, 4, 5, 6, 40, 300):
        text = "".join(rng.choice("abé漢") for _ in range(n))
        want = set()
        for at in range(max(n - 4, min(n, 1))):
            h = min(n, 5)
            for c in text[at : at + 5]:
                h = int(mix(h * 0x9E3779B97F4A7C15 + ord(c)))
            want.add(h)
        tokens = dedup.shingles(text)
        assert tokens.tolist() == sorted(want)
        if n:
            assert dedup.signature(tokens, 128).tolist() == [one(tokens, i) for i in range(128)]
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(2000)) for _ in range(20)]

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            for t in texts:
                f(t)
            took.append(time.process_time() - began)
        return min(took)

    def before(t):  # a permutation at a time
        codes = np.unique(dedup.shingles(t))
        return np.array([(codes * (dedup._STEPS[2 * i] | np.uint64(1)) + dedup._STEPS[2 * i + 1]).min() for i in range(128)], np.uint64)

    assert least(lambda t: dedup.signature(dedup.shingles(t), 128)) < 0.8 * least(before)
