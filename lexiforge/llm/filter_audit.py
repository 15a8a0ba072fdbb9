"""Interaction audit of quality filters: what each filter removes, alone and in every order.

Five filters fail texts: A few words, B few distinct words, C many capitals, D marks of markup, E the text of a smaller
doc_id.  A text's failures are a mask of five bits, and every figure of the report is a sum over masks:

1. each task scans its texts once and writes (doc_id, part, mask of A to D, 64-bit hash of the text);
2. tasks count the hashes in counting Bloom sketches, which are merged in a tree; a text for which a counter stays at
   one is certainly unique, and is cleared of E without being moved;
3. only the texts that may repeat are shuffled, aggregated by whole text to its smallest doc_id before and after the
   shuffle, so that a text that fills a third of the table is one row a task;
4. the rows that hold those smallest ids, found by (hash, doc_id), pass E and the other possible repeats fail it;
   flags and labels make a mask, and masks are counted per part.

The sketch has ``SLOTS_PER_TEXT`` counters a document and ``MAX_SLOTS`` at most, its broadcast a quarter of that in bytes;
beyond some tens of millions of texts more of them are possible repeats and are shuffled, and the result stays exact.

Defined results: a null text is empty; a null source is the part ''; a null doc_id has no smaller one, is smaller than
none and has no labels; rows that repeat a doc_id and a text count each, and neither fails E through the other; a
document counts as good (toxic) if any of its ``labels`` rows says so; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import blocks
from lexiforge.llm import words as W
from lexiforge.llm.common import Scratch, table

FILTERS = "ABCDE"
#: Counters of the sketch: so many a document, the next power of two, and not above the bound.
SLOTS_PER_TEXT = 16
MAX_SLOTS = 1 << 27
#: Counters that a text's hash raises.
PROBES = 3
_BLOCK = 1 << 16
#: Rows of hashes that one partial sketch counts at least.
_ROWS = 1 << 18
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def failures(text: str | None) -> int:
    """The mask of A (1), B (2), C (4) and D (8) for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: at exactly the six ASCII separators
    n, distinct = len(words), len(set(words))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    marked = len(data) != len(data.translate(None, _MARKS))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * len(text)) << 2 | marked << 3


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h, mask) per row: the failures of A to D, and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([failures(t.as_py()) for t in batch.column(3)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["doc_id", "part", "h", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_hash().alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, h long, mask int")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def slots_of(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """The counters that each hash raises, by double hashing."""
    h = np.asarray(h, np.int64).view(W.U64)
    first, step = W.mix(h), W.mix(h ^ W.U64(0x9E3779B97F4A7C15)) | W.U64(1)
    return [((first + W.U64(i) * step) & W.U64(slots - 1)).astype(np.int64) for i in range(PROBES)]


def counting_sketch(hashes: DataFrame, rows: int) -> np.ndarray:
    """Counters of 0, 1 or 2 (more) over all ``hashes`` (h), merged from the tasks' sketches."""
    slots = min(MAX_SLOTS, max(_BLOCK, 1 << (SLOTS_PER_TEXT * max(rows, 1) - 1).bit_length()))
    # few large sketches instead of one for each file
    tasks = max(1, min(hashes.rdd.getNumPartitions(), -(-rows // _ROWS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(slots, np.uint8)
        for batch in batches:
            raised = np.concatenate(slots_of(batch.column(0).to_numpy(), slots))
            at, times = np.unique(raised, return_counts=True)
            total[at] = np.minimum(total[at] + np.minimum(times, 2), 2)
        yield from blocks.cut(TaskContext.get().partitionId(), total, _BLOCK)

    add = lambda a, b: np.minimum(a + b, 2)
    return blocks.merged(hashes.select("h").coalesce(tasks).mapInArrow(count, blocks.KIND), tasks, slots, np.uint8, _BLOCK, add)


def possible_repeats(spark: SparkSession, sketch: np.ndarray) -> object:
    """A column function: whether a hash may have been counted more than once.  False is certain."""
    slots = len(sketch)
    shared = spark.sparkContext.broadcast(np.packbits(sketch > 1))  # a bit a counter

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        bits = shared.value
        out = np.ones(len(h), bool)
        for at in slots_of(h.to_numpy(), slots):
            out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return may_repeat


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of a mask."""
    spark = docs.sparkSession
    tables = Scratch(spark)
    flags = tables.write(masks(docs), "masks")
    may_repeat = possible_repeats(spark, counting_sketch(flags, flags.count()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    least = texts.where("doc_id is not null").where(may_repeat("h")).groupBy("h", "text").agg(F.min("doc_id").alias("doc_id"))
    first = tables.write(least.select("h", "doc_id").distinct(), "firsts")
    flags = flags.withColumn("repeat", may_repeat("h") & F.col("doc_id").isNotNull())
    clear = flags.where("not repeat").select("doc_id", "part", "mask")
    rest = flags.where("repeat").join(first.withColumn("is_first", F.lit(True)), ["h", "doc_id"], "left")
    rest = rest.select("doc_id", "part", F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"))
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    judged = judged.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = clear.union(rest).join(judged, "doc_id", "left")
    summed = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    out = tables.write(summed, "mask-counts")
    tables.drop(flags, first)
    return out


def report(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the counts of masks."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = cells.select("part", "cells", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda where: sum((F.when(where(F.instr("filter_order", x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"before": bits(lambda at: at < F.col("step")), "own": bits(lambda at: at == F.col("step"))})
    fails = lambda c, of: c["mask"].bitwiseAND(of) != 0
    before, own = F.col("before"), F.col("own")

    def total(which, value="n") -> Column:
        add = lambda s, c: s + F.when(which(c), c[value] if isinstance(value, str) else value(c)).otherwise(0)
        return F.aggregate("cells", F.lit(0).cast("long"), add)

    removed = lambda c: ~fails(c, before) & fails(c, own)
    # a text that fails s filters is removed by each of them in 120 / s of the orders
    share = lambda c: F.call_function("div", c["n"] * 120, F.bit_count(c["mask"]))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c, before.bitwiseOR(own))).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: fails(c, before) & fails(c, own)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total(lambda c: fails(c, own), share).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
