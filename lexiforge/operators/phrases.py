"""Frequent phrases of a few letters, counted level by level.

A phrase can only be frequent if what it consists of is: longer phrases are counted only where the shorter ones that they
begin and end with are frequent.  Before each level is shuffled, a count sketch that is merged from all tasks tells which
phrases cannot reach the limit; those never leave their task.  Sketches and marks only err on the side of counting, so
the counts are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators import blocks

LETTERS = "a-zà-öø-ÿ"
#: Counters of each of the sketch's rows, and bits that mark frequent phrases.
SLOTS, MARKS = 1 << 20, 1 << 24
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BLOCK = 1 << 15


def _slots(keys: np.ndarray, row: int, size: int) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(31))) * _SEEDS[row]
    return ((x ^ (x >> np.uint64(29))) & np.uint64(size - 1)).astype(np.int64)


def _letters(pattern: str) -> np.ndarray:
    """Which of the 65,536 code points of the basic plane are letters of the pattern."""
    found = re.compile(f"[{pattern}]")
    return np.array([bool(found.match(chr(c))) and not 0xD800 <= c < 0xE000 for c in range(1 << 16)])


def _windows(texts: list[str | None], size: int, letters: np.ndarray, marks: np.ndarray | None) -> np.ndarray:
    """The phrases of ``size`` letters, 16 bits a letter, but for those whose parts are not marked."""
    codes = np.frombuffer("\0".join(t or "" for t in texts).encode("utf-16-le", "replace"), np.uint16)
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inside = letters[codes]
    key, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(size):
        key = key << np.uint64(16) | codes[i : i + n]
        whole &= inside[i : i + n]
    key = key[whole]
    if marks is not None:
        for shift in (16, 0):  # what it begins with, and what it ends with
            at = _slots(key >> np.uint64(shift) & np.uint64((1 << 16 * (size - 1)) - 1), 0, MARKS)
            key = key[marks[at >> 3] >> (at & 7) & 1 == 1]
    return key


def frequent_phrases(texts: DataFrame, text: str, least: int, sizes: tuple[int, ...] = (2, 3, 4), letters: str = LETTERS) -> DataFrame:
    """(phrase, n): the runs of so many letters (two to four in a row, overlaps included) that occur ``least`` times in all
    texts.  Texts are taken as they are; nulls have no phrases; letters are those of the basic plane."""
    spark, is_letter, marks, out = texts.sparkSession, _letters(letters), None, None
    rows = texts.select(F.col(text).alias("text"))
    tasks = rows.rdd.getNumPartitions()
    for size in range(2, max(sizes) + 1):
        given = spark.sparkContext.broadcast((is_letter, marks))

        def count(batches: Iterator[pa.RecordBatch], size=size, given=given) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(2 * SLOTS, np.int64)
            for batch in batches:
                keys, n = np.unique(_windows(batch.column(0).to_pylist(), size, *given.value), return_counts=True)
                for row in (0, 1):
                    total[row * SLOTS :][:SLOTS] += np.bincount(_slots(keys, row, SLOTS), n, SLOTS).astype(np.int64)
            yield from blocks.cut(TaskContext.get().partitionId(), total, _BLOCK)

        sketch = blocks.merged(rows.mapInArrow(count, blocks.KIND), tasks, 2 * SLOTS, np.int64, _BLOCK, np.add)
        enough = spark.sparkContext.broadcast(np.packbits(sketch >= least, bitorder="little"))

        def exact(batches: Iterator[pa.RecordBatch], size=size, given=given, enough=enough) -> Iterator[pa.RecordBatch]:
            bits = enough.value
            for batch in batches:
                keys, n = np.unique(_windows(batch.column(0).to_pylist(), size, *given.value), return_counts=True)
                fits = np.ones(len(keys), bool)
                for row in (0, 1):
                    at = _slots(keys, row, SLOTS) + row * SLOTS
                    fits &= bits[at >> 3] >> (at & 7) & 1 == 1
                keys, n = keys[fits], n[fits]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        found = rows.mapInArrow(exact, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        if size < max(sizes):  # what is frequent, as bits: a bounded number of them, however many phrases there are

            def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                from pyspark import TaskContext

                own = np.zeros(MARKS // 8, np.uint8)
                for batch in batches:
                    at = _slots(batch.column(0).to_numpy().view(np.uint64), 0, MARKS)
                    np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
                yield from blocks.cut(TaskContext.get().partitionId(), own, _BLOCK)

            parts = found.select("key").coalesce(64)
            marks = blocks.merged(parts.mapInArrow(mark, blocks.KIND), 64, MARKS // 8, np.uint8, _BLOCK, np.bitwise_or)
        if size in sizes:
            named = found.select(_named(size).alias("phrase"), "n")
            out = named if out is None else out.union(named)
    return out


def _named(size: int) -> Column:
    """The letters of a key, from UTF-16."""
    wide = F.lpad(F.hex("key"), 16, "0")
    return F.decode(F.unhex(F.substring(wide, 17 - 4 * size, 4 * size)), "UTF-16BE")
