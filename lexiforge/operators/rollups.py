"""Roll-ups over event logs: usage and effectiveness, recommendations, lessons, histograms, recency and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_stats(events: DataFrame, by: str, effectiveness: Column, success: Column) -> DataFrame:
    """Per item: uses, success rate, mean effectiveness (a null counts as 0), last use, and 0.6 * rate + 0.4 * mean."""
    rate, mean = F.count_if(success) / F.count("*"), F.sum(F.coalesce(effectiveness, F.lit(0.0))) / F.count("*")
    return events.groupBy(by).agg(F.count("*").alias("n"), F.round(rate, 6).alias("success_rate"), F.round(mean, 6).alias("effectiveness"), F.max("ts").alias("last_used"), F.round(0.6 * rate + 0.4 * mean, 2).alias("score"))


def recommend(stats: DataFrame, by: str, preferred: Column, k: int, minimum: float = 0.3, bonus: float = 0.2) -> DataFrame:
    """The k best items of ``usage_stats``: the threshold is asked first, then preferred items get a bonus."""
    out = stats.where(F.col("score") >= minimum).withColumn("boosted", F.round(F.col("score") + F.when(preferred, bonus).otherwise(0.0), 6))
    return out.orderBy(F.col("boosted").desc(), by).limit(k).select(by, "score", "boosted")


def top_counts(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, by count and then value, as ``rank``."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), value)).cast("long")).where(F.col("rank") <= k)


def length_histogram(docs: DataFrame, by: list[str], cuts: tuple[int, ...] = (100, 300, 1000)) -> DataFrame:
    """Counts by group and length class; class i lies below the i-th cut."""
    bucket = sum(((F.length("text") >= c).cast("long") for c in cuts), F.lit(0).cast("long"))
    return docs.groupBy(*by, F.when(F.col("text").isNull(), F.lit(-1).cast("long")).otherwise(bucket).alias("length_class")).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_last(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def retained(rows: DataFrame, ts: str, days: int, always: Column | None = None) -> DataFrame:
    """Rows within ``days`` of the newest one, and those that ``always`` holds for."""
    newest = rows.agg(F.max(ts).alias("_newest"))
    keep = F.col(ts) >= F.col("_newest") - F.make_interval(days=F.lit(days))
    return rows.join(F.broadcast(newest)).where(keep if always is None else keep | always).drop("_newest")


def merged_state(updates: DataFrame, by: str, order: list[str], fields: list[str]) -> DataFrame:
    """Partial updates merged by key: of each field the last value that is not null."""
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c)
    return updates.groupBy(by).agg(*[newest(c) for c in fields], F.count("*").alias("n_updates"))


def rating(score: Column, cuts: tuple[tuple[float, str], ...] = ((52, "S"), (44, "A"), (35, "B"), (26, "C")), last: str = "D") -> Column:
    out = None
    for cut, name in cuts:
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out.otherwise(last)


def style_rollup(texts: DataFrame, by: str, pattern: str, k: int) -> DataFrame:
    """Per group: texts, mean length, and its k most frequent words as one string."""
    words = texts.select(by, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("word"))
    listed = top_counts(words, [by], "word", k).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("_w"))
    listed = listed.select(by, F.array_join(F.transform("_w", lambda x: F.concat_ws(":", x["word"], x["n"].cast("string"))), ",").alias("words"))
    totals = texts.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(F.length("text")) / F.count("text"), 6).alias("mean_length"))
    return totals.join(listed, by, "left")


def effectiveness(rows: DataFrame, item: str, scene: str, score: str, good: float = 7.0, bad: float = 6.0, k: int = 3) -> DataFrame:
    """Per item: uses, mean score, uses at ``good`` or more and below, and by their means the k best scenes that reach
    ``good`` and the k worst under ``bad``, each as one string."""
    scenes = rows.where(F.col(score).isNotNull()).groupBy(item, scene).agg(F.sum(score).alias("_sum"), F.count("*").alias("_n"), F.count_if(F.col(score) >= good).alias("_good"))
    mean = F.round(F.col("_sum") / F.col("_n"), 6)
    listed = lambda a: F.array_join(F.transform(F.slice(F.sort_array(a), 1, k), lambda x: x["scene"]), ",")
    entry = lambda by: F.struct(by.alias("by"), F.col(scene).cast("string").alias("scene"))
    out = scenes.groupBy(item).agg(
        F.sum("_n").alias("n"), F.round(F.sum("_sum") / F.sum("_n"), 6).alias("mean"), F.sum("_good").alias("n_good"), F.collect_list(F.when(mean >= good, entry(-mean))).alias("_best"), F.collect_list(F.when(mean < bad, entry(mean))).alias("_worst"),
    )
    return out.select(item, "n", "mean", "n_good", (F.col("n") - F.col("n_good")).alias("n_below"), listed(F.col("_best")).alias("best"), listed(F.col("_worst")).alias("worst"))


def lessons(logs: DataFrame, source: str, order: list[str], item: str, latest: int = 50, k: int = 10) -> DataFrame:
    """(item, n, rank): the k most frequent items in the last ``latest`` rows of each source, over all sources."""
    recent = keep_last(logs, [source], order, latest).where(F.col(item).isNotNull())
    return recent.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), item).limit(k)


def recurring(rows: DataFrame, by: list[str], value: str, least: int = 2) -> DataFrame:
    """Values that occur ``least`` times or more in a group, with their number."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def sources(rows: DataFrame, by: str, of: str, key: str, samples: int = 20) -> DataFrame:
    """Per group: rows, distinct values of ``of``, and its ``samples`` smallest keys as one string."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("_r") <= samples)
    listed = first.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("samples"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(of).alias("n_distinct")).join(listed, by, "left")
