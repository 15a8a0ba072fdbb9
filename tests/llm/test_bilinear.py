import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from lexiforge.llm import bilinear as B

DATA = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else " " if c in SPACES else c for c in text or "")
    return [w for w in text.split(" ") if w]


def held_out(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base(docs):
    counts = Counter()
    for i, t in docs:
        if not held_out(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return [(i, held_out(i), len(ts := [*words(t), None]), sum(counts[x] > 0 for x in ts), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), 6)) for i, t in docs]


def prose(n, seed=1):
    """Texts of three languages of invented words, of which half the tokens are of few words."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tongue = rng.choice("xyz")
        frequent = [tongue + s for s in ("a", "e", "i", "o", "u")]
        out.append((i, " ".join(rng.choice(frequent) if rng.random() < 0.5 else tongue + "".join(rng.choice("bcdf") for _ in range(rng.randrange(2, 6))) + tongue for _ in range(rng.randrange(5, 120)))))
    return out


def scored(spark, docs, parts=3, **extra):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as class", "'x' as word").repartition(parts)
    from pyspark.sql import functions as F

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return B.scored(df, ~held)


@pytest.mark.parametrize("head", (40, 1 << 18))
def test_base_equals_brute_force(spark, head, monkeypatch):
    monkeypatch.setattr(B, "HEAD_WORDS", head)
    rng = random.Random(6)
    docs = [*prose(300), (None, "Xa XA xa"), (10**6, None), (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \x0b\t"), (10**6 + 3, "ÀB b c d " * 30), (7, "again"), (10**6 + 4, "long " * 60_000)]
    docs += [(2 * 10**6 + i, " ".join(f"new{rng.randrange(10**6)}" for _ in range(50))) for i in range(30)]
    rows = scored(spark, docs).collect()
    got = [(r.doc_id, not r.trained, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got, key=str) == sorted(base(docs), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_model_beats_base_on_held_out_texts(spark):
    rows = [r for r in scored(spark, prose(3000)).collect() if not r.trained]
    assert len(rows) > 300
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.15 * tokens


def test_probabilities_sum_to_one(spark, monkeypatch):
    """Over all known words and one unknown word of each class of endings, after several contexts."""
    docs = prose(60)
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    counts = B.word_counts(texts)
    monkeypatch.setattr(B, "HEAD_WORDS", 100)
    v = B.Vocabulary.of(counts)
    rng = np.random.default_rng(2)
    network = B.Network.start(np.full(B.CLASSES, 1 / B.CLASSES))
    for x in network.values:
        x += rng.normal(0, 0.5, x.shape).astype(np.float32)
    by_first, by_second, z = (x.astype(float) for x in network.tables())
    share, unknown = v.within()
    of_class = np.zeros(B.CLASSES)
    for r in counts.collect():
        w = bytes(r.word)
        c = 0 if not w else int(v.head_class[v.head[w]]) if w in v.head else B.ending(w)
        of_class[c] += 10 ** (np.log10(r.n) + share[c])
    of_class[B.OWN :] += 10 ** unknown[B.OWN :]
    seen = v.class_tokens > 0
    assert np.allclose(of_class[seen], 1)
    for c1, c2 in ((0, 0), (5, 2000), (1700, 3)):
        p = np.exp(by_first[c1] + by_second[c2] - z[c1, c2])
        assert abs(p.sum() - 1) < 1e-3


def test_gradients_follow_the_objective():
    """The steps lower the loss of noise-contrastive estimation on the tokens that they were made for."""
    rng = np.random.default_rng(0)
    shares = np.full(B.CLASSES, 1 / B.CLASSES)
    network = B.Network.start(shares)
    c1, c2 = rng.integers(0, 20, 1000), rng.integers(0, 20, 1000)
    target = 100 + c1  # no class that is drawn as noise
    noise = rng.integers(0, 20, B.NOISE)
    expected = np.log(B.NOISE * shares).astype(np.float32)

    def loss():
        following, first, second, bias = network.values
        h = first[c1] + second[c2]
        s = np.einsum("ij,ij->i", h, following[target]) + bias[target] - expected[target]
        f = h @ following[noise].T + bias[noise] - expected[noise]
        return np.log1p(np.exp(-s)).mean() + np.log1p(np.exp(f)).sum(1).mean()

    before = loss()
    for _ in range(60):
        network.learn(c1, c2, target, noise, expected)
    assert loss() < 0.2 * before


def test_contexts():
    got = B.contexts([np.array([5, 6, 0]), np.array([0]), np.array([7, 0])])
    assert [x.tolist() for x in got] == [[0, 5, 6, 0, 0, 7], [0, 0, 5, 0, 0, 0], [5, 6, 0, 0, 7, 0]]


def test_empty_tables(spark):
    assert scored(spark, []).collect() == []
    alone = next(i for i in range(100) if held_out(i))
    r = scored(spark, [(alone, "Some words")]).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in r] == [(3, 0, 0, 0.0)] and math.isfinite(r[0].score)


def test_whole_table(spark):
    rows = B.op11_lm_scoring(spark, DATA).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(base(docs))
    kept = [r for r in rows if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)
