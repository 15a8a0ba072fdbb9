"""Discovery: keywords of a group against the rest, word pairs that occur together, and clusters of keyword pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import once
from lexiforge.profiles import Scene


def keywords(texts: DataFrame, by: str, pattern: str, k: int, least: int = 3) -> DataFrame:
    """Per group the k words with the highest share of its texts over their share of all, smoothed by one text; words
    of at least ``least`` texts.  Counts are added up before they are shuffled."""
    key = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))
    words = texts.select(by, F.explode(key).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    total = words.groupBy("word").agg(F.sum("n").alias("n_all"))
    sizes = texts.groupBy(by).agg(F.count("*").alias("n_texts"))
    n = texts.agg(F.count("*").alias("n_corpus"))
    lift = (F.col("n") / F.col("n_texts")) / ((F.col("n_all") + 1) / F.col("n_corpus"))
    scored = words.where(F.col("n") >= least).join(total, "word").join(sizes, by).join(F.broadcast(n)).withColumn("score", F.round(lift, 6))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("n").desc(), "word")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(by, "rank", "word", "n", "n_all", "score")


def cooccurrence(items: DataFrame, key: str, terms: tuple[str, ...]) -> DataFrame:
    """(a, b, n): for each pair of a fixed set of terms the number of texts that hold both.  A text gives at most as many
    rows as there are pairs of terms, and those are added up in its task."""
    held = F.filter(F.array(*[F.lit(t) for t in sorted(terms)]), lambda t: F.contains(F.lower("text"), t))
    pairs = items.select(held.alias("_h")).where(F.size("_h") > 1).select(F.explode(F.flatten(F.transform("_h", lambda a, i: F.transform(F.slice("_h", i + 2, F.size("_h")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("_p"))
    return pairs.groupBy("_p.a", "_p.b").agg(F.count("*").alias("n"))


def top_words(text: Column, pattern: str, stop: tuple[str, ...], k: int) -> Column:
    """The k most frequent words of a text of two characters at least that are no stop words, ties by their first place."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*stop))
    placed = lambda w: F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    # in sorted order a word is a run; its length is the distance to the next run's start
    starts = lambda p: F.filter(F.transform(p, lambda x, j: F.when((j == 0) | (x["w"] != F.get(p, j - 1)["w"]), j)), lambda j: j.isNotNull())
    count = lambda p, s, n, j: F.coalesce(F.get(s, n + 1), F.size(p)) - j
    ranked = lambda p: once(starts(p), lambda s: F.array_sort(F.transform(s, lambda j, n: F.struct((-count(p, s, n, j)).alias("n"), F.get(p, j)["i"].alias("i"), F.get(p, j)["w"].alias("w")))))
    return once(placed(words), lambda p: F.transform(F.slice(ranked(p), 1, k), lambda x: x["w"]))


def keyword_clusters(texts: DataFrame, pattern: str, stop: tuple[str, ...], scenes: tuple[Scene, ...] = (), k: int = 5, least: int = 10, top: int = 50) -> DataFrame:
    """(name, keywords, n): pairs among each text's k keywords, counted over all texts; the ``top`` pairs of ``least``
    texts at least are merged by name.  A pair is named after the first scene that has one of its words, else after
    itself.  A text gives k (k - 1) / 2 rows at most, which are added up before they are shuffled."""
    words = texts.select(F.array_sort(top_words(F.col("text"), pattern, stop, k)).alias("_h"))
    pairs = words.select(F.explode(F.flatten(F.transform("_h", lambda a, i: F.transform(F.slice("_h", i + 2, F.size("_h")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("_p"))
    often = pairs.groupBy("_p.a", "_p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "a", "b").limit(top)
    named = [F.when(F.col("a").isin(*known) | F.col("b").isin(*known), s.name) for s in scenes if (known := [w.strip() for w in s.keywords])]
    name = F.coalesce(*named, F.concat_ws(" ", "a", "b"))
    return often.withColumn("name", name).groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("keywords"), F.sum("n").alias("n"))
