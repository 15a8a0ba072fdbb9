import random

from lexiforge.llm.columns import running_max, running_sums, spans
from pyspark.sql import functions as F


def test_running_sums(spark):
    for n in (0, 1, 2, 63, 64, 65, 5000):
        got = spark.createDataFrame([([i % 7 for i in range(n)],)], "a array<int>").select(running_sums(F.col("a")).alias("s")).head().s
        want, total = [], 0
        for i in range(n):
            total += i % 7
            want.append(total)
        assert got == want


def test_spans(spark):
    row = spark.createDataFrame([("a1bb22\U0001f600333",)], "t string").select(spans(F.col("t"), "[0-9]+", 2).alias("s")).head().s
    assert [(x.start, x.end, x.match, x.before, x.after) for x in row] == [(1, 2, "1", "a", "bb"), (4, 6, "22", "bb", "\U0001f600"), (7, 10, "333", "\U0001f600", "")]


def test_running_max(spark):
    rng = random.Random(1)
    for n in (0, 1, 64, 65, 5000):
        values = [rng.randrange(10**6) - 10 for _ in range(n)]
        got = spark.createDataFrame([(values,)], "a array<int>").select(running_max(F.col("a")).alias("s")).head().s
        assert got == [max(values[: i + 1]) for i in range(n)]
