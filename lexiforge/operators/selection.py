"""Ranked selections with fallbacks, disagreements between groups of rows, rhythm and confidence of texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.rollups import keep_last


def primary_then_secondary(rows: DataFrame, by: str, kind: str, primary: str, secondary: str, score: str, key: str, k: int, least: float) -> DataFrame:
    """Per group up to ``k`` rows of ``least`` score or more, from the 2k best of the primary kind; only where these are
    under ``k`` before the score is looked at, the best of the secondary kind fill up.  Rows with a null kind never count."""
    best = F.row_number().over(Window.partitionBy(by, kind).orderBy(F.col(score).desc_nulls_last(), key))
    near = rows.where(F.col(kind).isin(primary, secondary)).withColumn("_r", best).where(F.col("_r") <= 2 * k)
    n = F.count_if(F.col(kind) == primary).over(Window.partitionBy(by))
    near = near.withColumn("_n", n).where(((F.col(kind) == primary) | (F.col("_r") <= k - F.col("_n"))) & (F.col(score) >= least))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), key))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).drop("_r", "_n")


def polar_examples(rows: DataFrame, by: str, positive: Column, score: str, key: str, k: int) -> DataFrame:
    """Per group the ``k`` best positive rows and half as many negative ones, one at least; null is neither."""
    ranked = rows.withColumn("positive", positive).where(F.col("positive").isNotNull())
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by, "positive").orderBy(F.col(score).desc_nulls_last(), key)))
    return ranked.where((F.col("rank") <= k) & (F.col("positive") | (F.col("rank") <= max(1, k // 2))))


def recent_or_any(rows: DataFrame, by: str, order: Sequence[str], wanted: Column, k: int) -> DataFrame:
    """Per group its ``k`` newest wanted rows; a group without any gives its newest rows of any kind."""
    newest = Window.partitionBy(by, "wanted").orderBy(*(F.col(c).desc_nulls_last() for c in order))
    near = rows.withColumn("wanted", F.coalesce(wanted, F.lit(False))).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)
    return near.withColumn("_any", F.max("wanted").over(Window.partitionBy(by))).where(F.col("wanted") | ~F.col("_any")).drop("_any")


def disagreements(rows: DataFrame, key: str, value: str, row_id: str) -> DataFrame:
    """Pairs of different values under one key, each value with its number of rows and its smallest row id.  Rows are
    counted per (key, value) first, so that the pairs grow with the values of a key and not with its rows."""
    classes = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(row_id).alias("first"), F.count("*").alias("n"))
    side = lambda s: classes.select(key, F.col(value).alias(f"value_{s}"), F.col("first").alias(f"first_{s}"), F.col("n").alias(f"n_{s}"))
    return side("a").join(side("b"), key).where("value_a < value_b")


def rhythm(text: Column, end: str = r"[.!?\n]") -> Column:
    """How the lengths of a text's sentences go: even, rising, falling, tight-loose-tight, loose-tight-loose, abrupt, broken
    or breathing.  A null text is even, as is one with fewer than two sentences."""
    lengths = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), end), lambda s: F.length(F.trim(s))), lambda n: n > 0)
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # evaluates ``value`` once
    total = lambda ns: F.aggregate(ns, F.lit(0).cast("long"), lambda a, n: a + n)

    def marked(ns: Column) -> Column:
        mean = total(ns) / F.size(ns)
        return bind(mean, lambda m: F.transform(ns, lambda n: F.when(n > m * 1.3, "L").when(n < m * 0.7, "S").otherwise("M")))

    def by_marks(ms: Column) -> Column:
        n, inner = F.size(ms), F.slice(ms, 2, F.greatest(F.size(ms) - 2, F.lit(0)))
        framed = lambda outer, within: (n >= 3) & (ms[0] == outer) & (F.element_at(ms, -1) == outer) & F.array_contains(inner, within)
        count = lambda mark: F.size(F.filter(ms, lambda m: m == mark))
        named = F.when(framed("S", "L"), "tight-loose-tight").when(framed("L", "S"), "loose-tight-loose")
        return named.when(n - count("M") > n * 0.6, "abrupt").when(count("S") >= n * 0.5, "broken").otherwise("breathing")

    def by_lengths(ns: Column) -> Column:
        even = (F.size(ns) < 2) | (F.array_max(ns) - F.array_min(ns) < 3)
        return F.when(even, "even").when(F.sort_array(ns) == ns, "rising").when(F.sort_array(ns, False) == ns, "falling").otherwise(bind(marked(ns), by_marks))

    return bind(lengths, by_lengths)


def phases(rows: DataFrame, by: Sequence[str], special: Column, limits: Sequence[tuple[int, str]] = ((50, "cold_start"), (300, "growing")), last: str = "mature") -> DataFrame:
    """Per group: rows, special ones and others, and the phase that their number puts it in."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(special).alias("n_special"))
    phase = F.lit(last)
    for limit, name in reversed(limits):
        phase = F.when(F.col("n") < limit, name).otherwise(phase)
    return out.withColumns({"n_normal": F.col("n") - F.col("n_special"), "phase": phase})


def recent_audit(rows: DataFrame, by: str, order: list[str], latest: int, flags: Mapping[str, Column]) -> DataFrame:
    """Per group, over its ``latest`` rows: how many carry each flag, and the flags that over half of them carry."""
    counted = keep_last(rows, [by], order, latest).groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in flags.items()))
    raised = F.array_join(F.array_compact(F.array(*(F.when(2 * F.col(name) > F.col("n"), name) for name in flags))), ",")
    return counted.withColumn("raised", raised)


def confidences(text: Column, cues: Mapping[str, float], enough: float, apart: float) -> Column:
    """Struct (intent, confidence, unsure).  A cue's confidence is its base and up to 0.05 more the earlier it stands, 1 at
    most.  Unsure: below ``enough``, or the next cue is within ``apart``; a text without cues has null and is unsure."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for cue, base in cues.items():
        at = F.instr(low, cue)
        found.append(F.when(at > 0, F.struct(F.round(F.least(F.lit(1.0), F.lit(base) + 0.05 * (1 - (at - 1) / F.length(low))), 6).alias("confidence"), F.lit(cue).alias("intent"))))
    ranked = F.sort_array(F.array_compact(F.array(*found)), False)
    best, second = F.get(ranked, 0), F.get(ranked, 1)
    near = F.coalesce(F.round(best["confidence"] - second["confidence"], 6) < apart, F.lit(False))
    return F.struct(best["intent"].alias("intent"), best["confidence"].alias("confidence"), (F.coalesce(best["confidence"] < enough, F.lit(True)) | near).alias("unsure"))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal values among the keys that two maps have in common; null without common keys."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.when(F.size(common) > 0, F.round(F.size(F.filter(common, lambda k: F.element_at(a, k).eqNullSafe(F.element_at(b, k)))) / F.size(common), 6))


def gated_candidates(rows: DataFrame, by: str, value: str, least: int) -> DataFrame:
    """Groups of ``least`` rows or more with a value: the most frequent one (of equals the smallest) and its share."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    out = counts.groupBy(by).agg(F.sum("_n").alias("n"), F.min_by(F.struct(F.col(value).alias("v"), "_n"), F.struct(-F.col("_n"), value)).alias("_b")).where(F.col("n") >= least)
    return out.select(by, "n", F.col("_b.v").alias("candidate"), F.round(F.col("_b._n") / F.col("n"), 6).alias("confidence"))


def described(template: str) -> Column:
    """The template with each ``{column}`` filled in; null is left empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def located(text: Column, cue: str, hint: str = "middle") -> Column:
    """Struct (paragraph, third): the first line with ``cue``, else the one that ``hint`` (beginning, middle, end) names, and
    the third of the text that it lies in.  A null text is one empty line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    n, at = F.size(lines), F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(cue))), True)
    named = {"beginning": F.lit(0), "middle": F.floor(n / 2), "end": n - 1}[hint]
    where = F.when(at > 0, at - 1).otherwise(named).cast("long")
    return F.struct(where.alias("paragraph"), F.when(where * 3 < n, "beginning").when(where * 3 < 2 * n, "middle").otherwise("end").alias("third"))
