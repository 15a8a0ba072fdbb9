"""Text statistics and quality as column expressions; only character pairs are counted outside the JVM, in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiforge.profiles import Profile


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def script_ratio(text: Column, script: str) -> Column:
    """Share of characters in a script; 0 for empty texts."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(f"[{script}]")) / F.length(text)).otherwise(0.0)


#: Unicode's white space.
_BLANK = np.zeros(0x3001, bool)
_BLANK[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def _pair_counts(text: str) -> tuple[int, np.ndarray]:
    """Characters that are no white space, and how often each pair of neighbours among them occurs."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = codes[~_BLANK[np.minimum(codes, 0x3000)] | (codes > 0x3000)]
    return len(codes), np.unique(codes[:-1] << 21 | codes[1:], return_counts=True)[1]


@F.pandas_udf(StructType([StructField("density", DoubleType()), StructField("entropy", DoubleType())]))
def _pair_statistics(texts: pd.Series) -> pd.DataFrame:
    density, entropy = [], []
    for t in texts:
        if t is None:
            density.append(None)
            entropy.append(None)
            continue
        n, counts = _pair_counts(t)
        density.append(len(counts) / (n - 1) if n >= 10 else 0.0)
        entropy.append(math.log2(n - 1) - float((counts * np.log2(counts)).sum()) / (n - 1) if n >= 20 else 0.0)
    return pd.DataFrame({"density": density, "entropy": entropy}, dtype="float64")


def pair_statistics(text: Column) -> Column:
    """A struct of ``density``, distinct character pairs over all (0 under 10 characters without white space), and
    ``entropy``, that of the pairs in bits (0 under 20)."""
    return _pair_statistics(text)


def is_ad(text: Column, profile: Profile) -> Column:
    return text.rlike(profile.ad_pattern)


def is_catalog(text: Column, profile: Profile) -> Column:
    """At least three non-blank lines, two fifths of which are chapter titles."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"(?U)\S"))
    return once(lines, lambda a: (F.size(a) >= 3) & (F.size(F.filter(a, lambda x: F.lower(x).rlike(profile.title_pattern))) * 5 >= F.size(a) * 2))


def ends_sentence(text: Column, profile: Profile) -> Column:
    last = F.right(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit(1))
    return (last != "") & last.isin(*profile.enders)


def clean_lines(text: Column, profile: Profile) -> Column:
    """Lines of two characters or more, trimmed, that hold no bad phrase and are no advert; joined again."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    bad = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(p)) for p in profile.bad_lines], x.rlike(profile.ad_pattern))
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 2) & ~bad(x)), "\n")


def count_of(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def quality_score(text: Column, matches: Column, keyword_score: Column, profile: Profile, pairs: Column | None = None) -> Column:
    """Additive score from 0 to 10: keywords, good length, forbidden phrases, dialogue, pair density, ending, entropy.
    ``pairs`` are the pair statistics of the text, if they are at hand."""
    forbidden = reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(p)), 0.5).otherwise(0.0) for p in profile.forbidden], F.lit(0.0))
    quotes = reduce(lambda a, b: a + b, [count_of(text, q) for q in profile.quotes])
    n = F.length(text)

    def total(density: Column, entropy: Column) -> Column:
        parts = [
            F.lit(profile.base_score), F.least(F.greatest(keyword_score, matches.cast("double")) * 0.3, F.lit(1.5)), F.when(n.between(500, 2000), 0.5).otherwise(0.0), -forbidden,
            F.when(quotes >= 4, 0.3).otherwise(0.0), F.when(density >= 0.6, 0.3).when(density < 0.3, -0.5).otherwise(0.0), F.when(ends_sentence(text, profile), 0.0).otherwise(-0.5),
            F.when(n > 100, F.when(entropy < 6, -1.5).when(entropy > 8, 0.3).otherwise(0.0)).otherwise(0.0),
        ]
        return F.greatest(F.lit(0.0), F.least(F.lit(10.0), reduce(lambda a, b: a + b, parts)))

    pairs = pair_statistics(text) if pairs is None else pairs
    return F.when(text.isNotNull(), total(pairs["density"], pairs["entropy"]))


def sentences(text: Column, enders: str = ".!?") -> Column:
    """Parts between sentence enders, trimmed, without empty ones."""
    parts = F.transform(F.split(text, f"[{enders}]", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def stylometrics(text: Column, profile: Profile) -> Column:
    """A struct of sentence count, mean and spread of sentence lengths, dialogue share and imagery level."""

    def of(s: Column) -> Column:
        lengths = F.transform(s, lambda x: F.length(x).cast("double"))
        mean = F.when(F.size(s) > 0, F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / F.size(s)).otherwise(0.0)

        def rest(m: Column) -> Column:
            spread = F.when(F.size(s) > 0, F.sqrt(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(s))).otherwise(0.0)
            hits = reduce(lambda a, b: a + b, [F.contains(F.lower(text), F.lit(w)).cast("int") for w in profile.imagery], F.lit(0))
            density = hits / F.greatest(F.lit(1.0), F.length(text) / 50)
            level = F.when(density < 0.5, "low").when(density < 1.5, "medium").otherwise("high")
            return F.struct(F.size(s).cast("long").alias("n_sentences"), m.alias("mean_length"), spread.alias("spread"), level.alias("imagery"))

        return once(mean, rest)

    return once(sentences(text), of)


def case_id(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur at all."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def keyword_count(text: Column, words: tuple[str, ...]) -> Column:
    """Occurrences of all words; a word listed twice counts twice."""
    return reduce(lambda a, b: a + b, [count_of(text, w) for w in words], F.lit(0))


def lexeme_density(text: Column, words: tuple[str, ...]) -> Column:
    """Occurrences of all words over characters, to three places; 0 for empty texts."""
    return F.when(F.length(text) > 0, F.round(keyword_count(F.lower(text), words) / F.length(text), 3)).otherwise(0.0)


def perspective(text: Column, persons: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The name of the person whose words occur most often, the first of equal ones; ``none`` without any."""
    counts = F.array(*[F.struct(keyword_count(F.lower(text), words).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(persons)])
    return once(F.array_max(counts), lambda best: F.when(best["n"] > 0, best["name"]).otherwise("none"))


def clauses(text: Column, low: int, high: int) -> Column:
    """The parts between punctuation, trimmed, that have ``low`` to ``high`` characters."""
    parts = F.transform(F.split(text, r"[.,;:!?\n]", -1), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x).between(low, high))
