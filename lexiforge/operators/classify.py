"""Rule classifiers: genres by keyword vote, scenes by length, position, negative and weighted keywords; intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.profiles import Profile


def genre(text: Column, profile: Profile, unknown: str = "unknown") -> Column:
    """The genre with most keyword occurrences, the first of equals, if they reach the threshold."""
    votes = F.array(*[F.struct(T.keyword_count(text, words).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, words) in enumerate(profile.genres)])
    return T.once(F.array_max(votes), lambda v: F.when(v["n"] >= profile.genre_threshold, v["name"]).otherwise(unknown))


def best_scene(text: Column, profile: Profile) -> Column:
    """(name, matches) of the scene most of whose keywords occur, the first of equals; null without any."""
    hits = F.array(*[F.struct(T.keyword_hits(text, s.keywords).alias("n"), F.lit(-i).alias("o"), F.lit(s.name).alias("name")) for i, s in enumerate(profile.scenes)])
    return T.once(F.array_max(hits), lambda v: F.when(v["n"] > 0, F.struct(v["name"].alias("name"), v["n"].alias("n"))))


def paragraphs(docs: DataFrame, profile: Profile, separator: str = r"\n\s*\n") -> DataFrame:
    """(doc_id, index, n_paragraphs, paragraph): cleaned paragraphs of fair length in the profile's script, neither
    adverts nor tables of contents.  Positions are those among the kept paragraphs of a document."""
    cleaned = F.transform(F.split("text", separator, -1), lambda p: T.clean_lines(p, profile))
    fair = F.filter(cleaned, lambda p: F.length(p).between(profile.min_paragraph, profile.max_paragraph) & ~T.is_ad(p, profile) & ~T.is_catalog(p, profile) & (T.script_ratio(p, profile.script) >= profile.min_script))
    kept = docs.select("doc_id", fair.alias("_p"))
    return kept.select("doc_id", F.size("_p").alias("n_paragraphs"), F.posexplode("_p").alias("index", "paragraph"))


def scenes(parts: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, index, scene, score): every scene a paragraph of ``paragraphs`` belongs to."""

    def rule(s) -> Column:
        p, weights = F.col("paragraph"), dict(s.weights)
        score = reduce(lambda a, b: a + b, [F.contains(p, F.lit(w)).cast("double") * weights.get(w, 1.0) for w in s.keywords])
        place = {"start": F.col("index") <= 5, "end": F.col("index") >= F.col("n_paragraphs") - 5}.get(s.position, F.lit(True))
        enough = score >= s.min_score if s.min_score is not None else (T.keyword_hits(p, s.keywords) >= 2 if s.position == "any" else F.lit(True))
        bad = reduce(lambda a, b: a | b, [F.contains(p, F.lit(w)) for w in s.negative], F.lit(False))
        fits = F.length(p).between(s.min_length, s.max_length) & place & enough & ~bad
        return F.when(fits, F.struct(F.lit(s.name).alias("scene"), score.alias("score")))

    found = F.filter(F.array(*[rule(s) for s in profile.scenes]), lambda x: x.isNotNull())
    return parts.select("doc_id", "index", F.explode(found).alias("_s")).select("doc_id", "index", "_s.scene", "_s.score")


def intents(turns: DataFrame, rules: list[tuple[str, str, int]], key: list[str]) -> DataFrame:
    """(key, intent, n_rules, ambiguous): the intent of the first rule, by priority, that a text matches.  ``rules`` are
    (intent, pattern, priority); a text is ambiguous if several rules of its best priority match."""
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(rank).alias("rank"), F.lit(i).alias("i"), F.lit(name).alias("intent"))) for i, (name, p, rank) in enumerate(rules)]), lambda x: x.isNotNull())
    best = T.once(hits, lambda h: T.once(F.array_min(h), lambda b: F.struct(b["intent"].alias("intent"), F.size(F.filter(h, lambda x: x["rank"] == b["rank"])).cast("long").alias("n_rules"))))
    out = turns.select(*key, best.alias("_b"))
    return out.select(*key, F.coalesce("_b.intent", F.lit("none")).alias("intent"), "_b.n_rules", (F.col("_b.n_rules") > 1).alias("ambiguous"))


def boundary_delta(parts: DataFrame, key: str, position: str, vector: str, window: int = 3) -> DataFrame:
    """1 - cosine of the mean vectors of the ``window`` rows before a row and from it on; 1.0 at a side without rows."""
    w = Window.partitionBy(key).orderBy(position)
    total = lambda frame: F.aggregate(F.collect_list(vector).over(frame), F.expr("cast(null as array<double>)"), lambda a, v: F.when(a.isNull(), v.cast("array<double>")).otherwise(F.zip_with(a, v, lambda x, y: x + y)))
    out = parts.withColumns({"_a": total(w.rowsBetween(-window, -1)), "_b": total(w.rowsBetween(0, window - 1))})
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("_a"), F.col("_b")) / (F.sqrt(dot(F.col("_a"), F.col("_a"))) * F.sqrt(dot(F.col("_b"), F.col("_b"))) + 1e-9)
    return out.withColumn("delta", F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1.0).otherwise(1 - cosine)).drop("_a", "_b")
