"""Texts against many terms, both ways: which terms stand in a text, and in which terms a text stands.

The terms are one Aho-Corasick automaton that each Python worker builds once, so a text is read once, however many terms
there are.  The other way round a text that is no longer than the longest term is looked up by its rarest characters.
Terms are broadcast in blocks of a counted size, so there may be any number of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of a block, and characters at which a block ends before.
BLOCK_TERMS, BLOCK_CHARS = 200_000, 8 << 20
_BUILT: dict[int, tuple] = {}


class Terms:
    """A block of terms: the automaton, and their places by the characters they have."""

    def __init__(self, terms: list[tuple[int, str]]) -> None:
        names = defaultdict(list)
        for number, term in terms:
            names[term].append(number)
        self.names = dict(names)
        self.longest = max(map(len, self.names), default=0)
        self.automaton = ahocorasick.Automaton()
        for term in self.names:
            self.automaton.add_word(term, term)
        if self.names:
            self.automaton.make_automaton()
        self.having = defaultdict(set)
        for term in self.names:
            for n in (1, 2, 3):
                for i in range(len(term) - n + 1):
                    self.having[term[i : i + n]].add(term)

    def inside(self, text: str) -> dict[int, int]:
        """How often each term stands in the text, overlaps included."""
        found: dict[int, int] = defaultdict(int)
        if self.names:
            for _, term in self.automaton.iter(text):
                for number in self.names[term]:
                    found[number] += 1
        return found

    def around(self, text: str) -> list[int]:
        """The terms in which the text stands."""
        if not text or len(text) > self.longest:
            return []
        n = min(3, len(text))
        few = min((self.having.get(text[i : i + n], ()) for i in range(len(text) - n + 1)), key=len)
        return [number for term in few if text in term for number in self.names[term]]


def containment(texts: DataFrame, key: str, text: str, terms: DataFrame, term_key: str, term: str) -> DataFrame:
    """(key, term_key, n, within): for each term that stands in the text how often it does, and for each term in which the
    text stands one row with n = 0 and ``within`` true; a text equal to a term has both.  Nulls and empty strings are in
    nothing; rows that repeat a key each give rows."""
    spark = texts.sparkSession
    block = terms.where(F.length(term) > 0).select(F.col(term_key).cast("long").alias("number"), F.col(term).alias("term"))
    out, held, size = None, [], 0

    def searched(held: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(held)
        number = id(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if number not in _BUILT:
                _BUILT.clear()
                _BUILT[number] = Terms(shared.value)
            known = _BUILT[number]
            for batch in batches:
                rows: list[tuple] = []
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if value := value.as_py():
                        rows += [(name, t, n, False) for t, n in known.inside(value).items()]
                        rows += [(name, t, 0, True) for t in known.around(value)]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=[key, term_key, "n", "within"])

        return texts.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(run, f"{key} long, {term_key} long, n long, within boolean")

    for r in block.toLocalIterator():
        held.append((r.number, r.term))
        size += len(r.term)
        if len(held) == BLOCK_TERMS or size >= BLOCK_CHARS:
            found = searched(held)
            out, held, size = found if out is None else out.union(found), [], 0
    found = searched(held) if held or out is None else None
    return out if found is None else found if out is None else out.union(found)


def mapped_feedback(feedback: DataFrame, key: str, points: str, patterns: list[tuple[str, str, str, list[str]]], scene: str, scenes: dict[str, tuple[str, str]], writer: str, writers: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, dimension, category, suggestions, confidence) of feedback with an array of ``points``.

    A point takes the first of ``patterns`` (pattern, dimension, category, suggestions) that stands in it or in which it
    stands; the last point with one decides, and suggestions of all points are put together (sorted, without repeats).
    Confidence is 0.8 then; else 0.6 if ``scenes`` knows the scene, else 0.5 if ``writers`` knows the writer, else 0."""
    known = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(c).alias("c"), F.array(*[F.lit(x) for x in s]).cast("array<string>").alias("s")) for p, d, c, s in patterns])
    meets = lambda point: F.get(F.filter(known, lambda k: F.contains(point, k["p"]) | F.contains(k["p"], point)), F.lit(0))
    hits = F.filter(F.transform(F.coalesce(points, F.array().cast("array<string>")), meets), lambda h: h.isNotNull())

    def of(values: dict[str, tuple[str, str]], column: str) -> Column:
        out = F.lit(None).cast("struct<d:string,c:string>")
        for name, (d, c) in values.items():
            out = F.when(F.col(column) == name, F.struct(F.lit(d).alias("d"), F.lit(c).alias("c"))).otherwise(out)
        return out

    rows = feedback.select(key, hits.alias("_h"), of(scenes, scene).alias("_s"), of(writers, writer).alias("_w"))
    last = F.try_element_at("_h", F.lit(-1))
    pick = lambda f: F.coalesce(last[f], F.col(f"_s.{f}"), F.col(f"_w.{f}"))
    return rows.select(
        key, pick("d").alias("dimension"), pick("c").alias("category"), F.sort_array(F.array_distinct(F.flatten(F.transform("_h", lambda h: h["s"])))).alias("suggestions"),
        F.when(F.size("_h") > 0, 0.8).when(F.col("_s").isNotNull(), 0.6).when(F.col("_w").isNotNull(), 0.5).otherwise(0.0).alias("confidence"),
    )
