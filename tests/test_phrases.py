"""Frequent phrases against a plain count."""

import random
import re
from collections import Counter

import pytest

from lexiforge.operators import phrases


def brute(texts, least, sizes=(2, 3, 4)):
    counts = Counter(run[i : i + k] for t in texts for run in re.findall("[a-zà-öø-ÿ]+", t or "") for k in sizes for i in range(len(run) - k + 1))
    return {p: n for p, n in counts.items() if n >= least}


@pytest.mark.parametrize("slots", (1 << 8, 1 << 20))
def test_phrases(spark, slots, monkeypatch):
    monkeypatch.setattr(phrases, "SLOTS", slots)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaabbcdeéß 9×") for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "a", "ab", "\U0001f600aa\0aa", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    for least, sizes in ((1, (2, 3, 4)), (20, (2, 3, 4)), (20, (4,))):
        assert {r.phrase: r.n for r in phrases.frequent_phrases(df, "text", least, sizes).collect()} == brute(texts, least, sizes)
    assert phrases.frequent_phrases(df.limit(0), "text", 1).collect() == []
