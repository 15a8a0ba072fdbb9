"""Lexicon rules: the first lexicon hit, votes, confidences, signals; rule tables as DataFrames; constraint menus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import keyword_hits, once

Lexicons = Mapping[str, Sequence[str]]


def first_hit(text: Column, lexicons: Lexicons, default: str | None = None) -> Column:
    """The first lexicon, in the order given, of which the text holds a word."""
    out = F.lit(default).cast("string")
    for name, words in reversed(list(lexicons.items())):
        out = F.when(keyword_hits(text, tuple(words)) > 0, name).otherwise(out)
    return out


def all_hits(text: Column, lexicons: Lexicons, least: int = 1, limit: int | None = None, default: Sequence[str] = ()) -> Column:
    """The lexicons of which a text holds at least ``least`` words, in order, the first ``limit`` of them."""
    found = F.array_compact(F.array(*[F.when(keyword_hits(text, tuple(words)) >= least, F.lit(name)) for name, words in lexicons.items()]))
    cut = found if limit is None else F.slice(found, F.lit(1), F.lit(limit))
    return once(cut, lambda a: F.when(F.size(a) == 0, F.array(*[F.lit(d) for d in default]).cast("array<string>")).otherwise(a))


def vote(text: Column, lexicons: Lexicons, bonus: Mapping[str, Column] | None = None, default: str | None = None) -> Column:
    """The lexicon with most words in the text plus its bonus, the first of equals; the default without any."""
    bonus = bonus or {}
    votes = F.array(*[F.struct((keyword_hits(text, tuple(w)) + bonus.get(n, F.lit(0))).cast("double").alias("n"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, (n, w) in enumerate(lexicons.items())])
    return once(F.array_max(votes), lambda v: F.when(v["n"] > 0, v["name"]).otherwise(F.lit(default).cast("string")))


def confidence(fragments: Column, similarity: Column, keywords: Column, quality: Column) -> Column:
    """.25 min(fragments / 100, 1) + .30 similarity + .25 min(keywords / 10, 1) + .20 (quality - 6) / 4, from 0 to 1."""
    total = 0.25 * F.least(fragments / 100, F.lit(1.0)) + 0.30 * similarity + 0.25 * F.least(keywords / 10, F.lit(1.0)) + 0.20 * (quality - 6) / 4
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def length_change(before: Column, after: Column) -> Column:
    """How a text's length changed: expanded over 1.3, condensed under 0.7, kept within a tenth, else adjusted."""
    ratio = F.length(after) / F.greatest(F.length(before), F.lit(1))
    return F.when(ratio > 1.3, "expanded").when(ratio < 0.7, "condensed").when(F.abs(ratio - 1) <= 0.1, "kept").otherwise("adjusted")


def weighted_score(scores: DataFrame, by: str, dimension: str, score: str, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(by, total, weighted): scores clipped to each dimension's maximum, added up, and as a weighted percentage.
    ``limits`` gives (maximum, weight) by dimension; unknown dimensions count nothing."""
    known = F.create_map(*[x for d, (m, w) in limits.items() for x in (F.lit(d), F.struct(F.lit(float(m)).alias("m"), F.lit(float(w)).alias("w")))])
    rows = scores.withColumn("_l", F.try_element_at(known, F.col(dimension))).where("_l is not null").withColumn("_s", F.greatest(F.lit(0.0), F.least(F.col(score), F.col("_l.m"))))
    return rows.groupBy(by).agg(F.round(F.sum("_s"), 6).alias("total"), F.round(F.sum(F.col("_s") / F.col("_l.m") * 100 * F.col("_l.w")), 6).alias("weighted"))


def exemptions(items: DataFrame, key: str, dimensions: str, sub_items: str) -> DataFrame:
    """(key, dimension, sub_item) of every exemption, from arrays; an empty list of sub-items exempts all, as null."""
    rows = items.select(key, F.explode(dimensions).alias("dimension"), sub_items)
    return rows.select(key, "dimension", F.explode_outer(sub_items).alias("sub_item")).distinct()


def not_exempt(findings: DataFrame, exempt: DataFrame, key: str) -> DataFrame:
    """Findings (key, dimension, sub_item, ...) that no exemption covers."""
    whole = exempt.where("sub_item is null").select(key, "dimension").distinct()
    return findings.join(exempt.where("sub_item is not null"), [key, "dimension", "sub_item"], "left_anti").join(whole, [key, "dimension"], "left_anti")


def menu(constraints: DataFrame, scene: str | None = None, word: str | None = None) -> DataFrame:
    """Active constraints, for a scene type and holding a word if given, by category and id."""
    if word is not None and not word.strip():
        raise ValueError("a blank word matches everything")
    rows = constraints.where("status = 'active'")
    if scene is not None:
        rows = rows.where(F.array_contains("trigger_scene_types", scene))
    if word is not None:
        rows = rows.where(F.contains(F.lower("constraint_text"), F.lit(word.lower())))
    return rows.select("id", "category", "constraint_text", "intensity", "trigger_scene_types").orderBy("category", "id")


def sample_varied(rows: DataFrame, key: str, category: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in an order that the seed shuffles, one of each category before any second one."""
    from pyspark.sql import Window

    order = F.xxhash64(F.col(key), F.lit(seed))
    ranked = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(category).orderBy(order, key)))
    return ranked.orderBy("_turn", order, key).limit(n).drop("_turn")


def signals(text: Column, lexicons: Lexicons, strong: Sequence[str], weak: Sequence[str]) -> Column:
    """A struct of polarity (the first lexicon hit), intensity from 1 to 3 and the chapter number named, if any."""
    level = F.when(keyword_hits(text, tuple(strong)) > 0, 3).when(keyword_hits(text, tuple(weak)) > 0, 1).otherwise(2)
    chapter = F.regexp_extract(text, r"(?i)(?:chapter\s+|第)([0-9]+)", 1)
    return F.struct(first_hit(text, lexicons).alias("polarity"), level.alias("intensity"), F.when(chapter != "", chapter.cast("long")).alias("chapter"))
