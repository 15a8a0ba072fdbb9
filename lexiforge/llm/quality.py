"""Quality rules: text statistics, and a decision list learned from labelled documents.

Statistics are built-in column expressions.  The decision list is learned by sequential covering: a rule is a
conjunction of thresholds that is grown on two thirds of the labelled rows, pruned on the rest and kept if it is
precise; the rows it covers are taken out before the next rule is grown.  The bad rows that a rule covers which is not
kept are no longer sought, and the search goes on until none is left.  The list is emitted as one ordered CASE WHEN
expression.

Defined results: a null text counts as empty, and empty texts fail the base rules; repeated rows are judged alike;
without labels of both kinds the list is empty and only the base rules hold; a document with several labels has the
worst of them; null labels and labels of unknown documents count for nothing; other columns pass unused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.columns import let
from lexiforge.llm.common import table

#: At most so many labelled documents are used for training; those with the smallest hashed ids are taken.
TRAINING_ROWS = 20_000
#: Thresholds tried for each statistic lie between so many quantiles of the training rows.
CUTS = 40
#: A rule must be right about this share of the rows it covers, and cover so many bad ones, some of them for pruning.
MIN_PRECISION = 0.97
MIN_COVER = 5
MIN_COVER_PRUNING = 1

_WORD = r"[^\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "distinct")


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) and the ratios that rules may use."""

    def repeats(w: Column) -> Column:
        triples = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        triples = F.sort_array(F.slice(triples, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
        return let(triples, covered)

    def covered(t: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(t, i)["h"] == x["h"], F.lit(False))
        starts = F.transform(F.filter(t, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])
        step = lambda a: F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - x, F.lit(3))))
        return let(F.sort_array(starts), lambda a: F.aggregate(step(a), F.lit(0), lambda s, x: s + x))

    def counted(t: Column, w: Column, lines: Column) -> Column:
        count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), repeats(w).cast("long").alias("n_repeat_words"),
            count("[A-Z]").alias("n_upper"), count("[!?]").alias("n_marks"), count("[0-9]").alias("n_digits"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    def with_ratios(c: Column) -> Column:
        share = lambda x, of: c[x] / F.greatest(c[of], F.lit(1))
        ratios = {
            "words": c["n_words"].cast("double"), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper", "word_chars"), "marks": share("n_marks", "word_chars"), "digits": share("n_digits", "word_chars"), "distinct": share("n_distinct", "n_words"),
        }
        return F.struct(*[c[x].alias(x) for x in BASE], *[ratios[x].alias(x) for x in RATIOS])

    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(_WORD))
    words = lambda t: F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(let(words(t), lambda w: let(lines(t), lambda x: counted(t, w, x))), with_ratios),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, s: Column) -> Column:
        return s[self.feature] > self.cut if self.above else s[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule], s: Column) -> Column:
    """The decision list on the statistics ``s`` as an ordered conditional expression; true keeps a document."""
    out = None
    for rule in rules:
        whole = rule[0].column(s)
        for c in rule[1:]:
            whole = whole & c.column(s)
        out = F.when(whole, False) if out is None else out.when(whole, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, cuts: int = CUTS) -> list[Rule]:
    """The decision list for ``labels`` (doc_id, quality 0 or 1) on ``docs`` (doc_id, text).

    The labelled rows used are bounded by ``training_rows``, so they can be broadcast, and what comes to the driver,
    counts of equal binned rows, is bounded too.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "_good", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) == 0).alias("_prune"), let(statistics(F.col("text")), lambda s: F.struct(base_failed(s).alias("failed"), *[s[x].alias(x) for x in RATIOS])).alias("_s")
    ).select("_good", "_prune", "_s.failed", *[F.col(f"_s.{x}").alias(f"_f_{x}") for x in RATIOS])
    rows = rows.persist()
    passed = rows.where("not failed")  # the list only judges what the base rules leave
    try:
        at = [i / cuts for i in range(cuts)] + [0.005, 0.995]
        edges = passed.agg(*[F.percentile_approx(f"_f_{x}", at, 10_000).alias(x) for x in RATIOS]).head()
        edges = {x: between(edges[x] or ()) for x in RATIOS}
        bins = [sum((F.col(f"_f_{x}") > e).cast("int") for e in edges[x]) if edges[x] else F.lit(0) for x in RATIOS]
        counts = passed.groupBy("_good", "_prune", *[b.alias(x) for b, x in zip(bins, RATIOS, strict=True)]).count().collect()
    finally:
        rows.unpersist()
    counts = sorted((tuple(r[x] for x in RATIOS), r["_good"] == 0, r["_prune"], r["count"]) for r in counts)
    return cover(counts, edges)


def between(values: Sequence[float]) -> list[float]:
    """The middles of neighbouring values: a threshold keeps its distance from the rows on either side."""
    values = sorted(set(values))
    return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]


def cover(counts: list[tuple[tuple[int, ...], bool, bool, int]], edges: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over counted rows (bins, bad, for pruning, count).  Bin b of a statistic lies above its first b cuts."""
    index = {x: i for i, x in enumerate(RATIOS)}

    def holds(c: tuple[int, bool, int], bins) -> bool:
        return (bins[c[0]] > c[2]) == c[1]

    def tally(rows, rule):
        bad = good = 0
        for bins, is_bad, _, n in rows:
            if all(holds(c, bins) for c in rule):
                bad, good = bad + n * is_bad, good + n * (not is_bad)
        return bad, good

    def grow(rows):
        rule: list[tuple[int, bool, int]] = []
        while True:
            bad = sum(n for _, b, _, n in rows if b)
            good = sum(n for _, b, _, n in rows if not b)
            if not bad or not good:
                break
            best = (0.0, None)
            for x, i in index.items():
                by_bin: dict[int, list[int]] = {}
                for bins, b, _, n in rows:
                    by_bin.setdefault(bins[i], [0, 0])[b] += n
                low_bad = low_good = 0
                for cut in range(len(edges[x])):
                    g, b = by_bin.get(cut, (0, 0))
                    low_bad, low_good = low_bad + b, low_good + g
                    for above, p, q in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                        if p:
                            gain = p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (i, above, cut))
            if best[1] is None:
                break
            rule.append(best[1])
            rows = [r for r in rows if holds(best[1], r[0])]
        return rule

    rules: list[Rule] = []
    left = sought = counts
    while rule := grow([r for r in sought if not r[2]]):
        kept_out = [r for r in left if r[2]]
        worth = lambda rule: (lambda p, q: (p - q) / (p + q) if p + q else -1.0)(*tally(kept_out, rule))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        bad, good = tally(left, rule)
        out_bad, out_good = tally(kept_out, rule)
        covered = lambda r: all(holds(c, r[0]) for c in rule)
        if bad >= MIN_COVER and out_bad >= MIN_COVER_PRUNING and bad >= MIN_PRECISION * (bad + good) and out_bad >= MIN_PRECISION * (out_bad + out_good):
            rules.append(tuple(Condition(RATIOS[i], above, edges[RATIOS[i]][cut]) for i, above, cut in rule))
            left = [r for r in left if not covered(r)]
            sought = [r for r in sought if not covered(r)]
        else:
            sought = [r for r in sought if not (r[1] and covered(r))]
    return rules


def judged(text: Column, rules: list[Rule]) -> Column:
    """The statistics of a text with base_failed and kept."""
    kept = lambda s: ~base_failed(s) & verdict(rules, s)
    return let(statistics(text), lambda s: F.struct(*[s[x].alias(x) for x in (*BASE, *RATIOS)], base_failed(s).alias("base_failed"), kept(s).alias("kept")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", judged(F.col("text"), rules).alias("_s")).select("doc_id", *[f"_s.{x}" for x in (*BASE, "base_failed", "kept")])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep."""
    return docs.where(judged(F.col("text"), learn(docs, labels))["kept"])
