"""Consistency checks: references, settings audits, conflicts, prohibitions, snapshot differences, weighted scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators import ordered


def missing_references(rows: DataFrame, column: str, others: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` that are no ``key``, and how many rows have them; nulls refer to nothing."""
    return rows.where(F.col(column).isNotNull()).join(others.select(F.col(key).alias(column)).distinct(), column, "left_anti").groupBy(column).agg(F.count("*").alias("n"))


def audit(items: DataFrame, settings: DataFrame, keys: Sequence[str], value: str, known: str) -> DataFrame:
    """Each item held against the settings: duplicate where they agree, conflict where not, new where none is known."""
    found = items.join(settings, list(keys), "left")
    verdict = F.when(F.col(known).isNull(), "new").when(F.col(value).eqNullSafe(F.col(known)), "duplicate").otherwise("conflict")
    return found.withColumn("verdict", verdict)


def conflicts(rows: DataFrame, group: str, key: str, attribute: str) -> DataFrame:
    """Groups whose rows disagree in ``attribute``: the number of pairs (i < j) that do, from counts and without pairing
    rows, and the first two values."""
    counts = rows.where(F.col(attribute).isNotNull()).groupBy(group, attribute).agg(F.count("*").alias("c"), F.min(key).alias("k"))
    total = counts.groupBy(group).agg(F.sum("c").alias("_n"), F.sum(F.col("c") * F.col("c")).alias("_q"), F.count("*").alias("n_values"), F.min(attribute).alias("low"), F.max(attribute).alias("high"))
    return total.where("n_values > 1").select(group, "n_values", ((F.col("_n") * F.col("_n") - F.col("_q")) / 2).cast("long").alias("n_pairs"), "low", "high")


def longest_prefix(items: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """``items`` with the longest name that its text begins with.  Names meet texts at equal prefixes of each length that
    a name has, so it is an equi-join."""
    lengths = [r[0] for r in names.select(F.length(name)).distinct().orderBy(F.length(name).desc()).collect()]
    prefixes = F.array_distinct(F.filter(F.array(*[F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in lengths]), lambda x: x.isNotNull())) if lengths else F.array().cast("array<string>")
    numbered = items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("_row"), prefixes.alias("_prefixes"))
    numbered = numbered.groupBy("_row", "_prefixes").agg(F.count("*").alias("_n"))  # equal rows are looked up once and come back as often
    met = numbered.select("_row", "_n", F.explode_outer("_prefixes").alias(name)).join(names.select(name).distinct().withColumn("_known", F.lit(True)), name, "left")
    best = met.groupBy("_row", "_n").agg(F.max_by(F.when(F.col("_known"), F.col(name)), F.when(F.col("_known"), F.length(name))).alias(name))
    return best.select("_row", name, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*", name)


def prohibitions(texts: DataFrame, key: str, rules: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(key, rule, n): rules (name, pattern, threshold) that a text breaks, with the number of matches."""
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias("n"), F.lit(limit).alias("limit")) for name, p, limit in rules])
    return texts.select(key, F.explode(F.filter(counts, lambda x: x["n"] >= x["limit"])).alias("_r")).select(key, "_r.rule", "_r.n")


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): created, deleted or modified between two snapshots (key, digest)."""
    both = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was")).join(new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is")), key, "full_outer")
    change = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def regressions(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is below that of the row before it in the group."""
    before = ordered.with_row_before(rows, by, order, [value])
    return before.withColumn("before", F.col(f"_before.{value}")).drop("_before").where(F.col(value) < F.col("before"))


def meets_limits(rows: DataFrame, by: str, measures: dict[str, Column], limits: dict[str, float]) -> DataFrame:
    """(by, measures ..., n_met, passed): each group's mean of every measure, and whether all reach their limits."""
    means = rows.groupBy(by).agg(*[F.round(F.avg(c), 6).alias(name) for name, c in measures.items()])
    met = sum(((F.col(name) >= limit).cast("long") for name, limit in limits.items()), F.lit(0).cast("long"))
    return means.withColumn("n_met", F.coalesce(met, F.lit(0))).withColumn("passed", F.col("n_met") == len(limits))


def first_unknown(candidates: DataFrame, known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first candidate of each key that is not known."""
    first = Window.partitionBy(key).orderBy(*order)
    new = candidates.join(known.select(key).distinct(), key, "left_anti")
    return new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def prefix_counts(rows: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    """(prefix, n): how many values begin with each prefix, in one pass."""
    found = F.array(*[F.struct(F.lit(p).alias("prefix"), F.startswith(F.col(column), F.lit(p)).alias("hit")) for p in prefixes])
    return rows.select(F.explode(found).alias("_p")).groupBy("_p.prefix").agg(F.count_if("_p.hit").alias("n"))
