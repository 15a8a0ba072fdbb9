"""Joins of sets by how much of the smaller one they share, and conflicts between records that share members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexiforge.sources.shared import written

#: Sets of the left side, and items in them, up to which they are broadcast; sets of a batch, and pairs that are counted at a time.
FEW_SETS, FEW_ITEMS, BATCH, _CELLS = 20_000, 1_000_000, 1000, 1 << 20
#: Sets with one item that meet in one place.
_PART = 512


def overlapping(left: DataFrame, left_key: str, right: DataFrame, right_key: str, items: str, share: float = 0.5) -> DataFrame:
    """(left_key, right_key, common): pairs of sets (key, items array) whose common items are at least ``share`` of the
    smaller set; ``common`` is their number.  Null and empty sets meet nothing, repeated items count once, keys are distinct.

    Items are ordered from rare to frequent.  The smaller set of a pair must have a common item among its first
    size - needed + 1, so only these are joined with the other side; an item of many sets is dealt to parts.  If the sets
    of the left side are few, they are broadcast instead, and the other side streams past them without a shuffle."""
    few = left.where(F.col(left_key).isNotNull()).select(left_key, F.array_distinct(F.filter(items, lambda i: i.isNotNull())).alias("_i")).where(F.size("_i") > 0)
    n, total = few.agg(F.count("*"), F.coalesce(F.sum(F.size("_i")), F.lit(0))).head()
    if n <= FEW_SETS and total <= FEW_ITEMS:
        return _past(few, left_key, right, right_key, items, share)
    a, b = (df.select(F.col(k).alias(c), F.explode(F.array_distinct(items)).alias("item")).where("item is not null") for df, k, c in ((left, left_key, "x"), (right, right_key, "y")))
    counts = a.groupBy("item").agg(F.count("*").alias("n")).union(b.groupBy("item").agg(F.count("*").alias("n"))).groupBy("item").agg(F.sum("n").alias("_often"))
    counts = counts.withColumn("_parts", (F.floor((F.col("_often") - 1) / _PART) + 1).cast("int"))

    def ranked(rows: DataFrame, c: str) -> DataFrame:
        each = rows.join(counts, "item").groupBy(c).agg(F.sort_array(F.collect_list(F.struct("_often", "item", "_parts"))).alias("_i"))  # one set
        size = F.size("_i")
        head = F.transform("_i", lambda i, at: F.struct(i["item"].alias("item"), i["_parts"].alias("parts"), (at <= size - F.ceil(size * share)).alias("first")))
        return each.select(c, size.alias(f"_n{c}"), F.explode(head).alias("_p")).select(c, f"_n{c}", "_p.*")

    x, y = ranked(a, "x"), ranked(b, "y")

    def met(small: DataFrame, large: DataFrame, s: str, t: str, fits: Column) -> DataFrame:
        whole = large.withColumn("part", F.pmod(F.xxhash64(t), F.col("parts")).cast("int")).select("item", "part", t, f"_n{t}")
        heads = small.where("first").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("item", "part", s, f"_n{s}")
        return heads.join(whole.hint("merge"), ["item", "part"]).where(fits).select("x", "y")

    pairs = met(x, y, "x", "y", F.col("_nx") <= F.col("_ny")).union(met(y, x, "y", "x", F.col("_ny") < F.col("_nx"))).distinct()
    # the sets are fetched once a pair; one in very many pairs is split by the engine, as no row of a pair needs another
    sets = lambda rows, k, c: rows.select(F.col(k).alias(c), F.array_distinct(F.filter(items, lambda i: i.isNotNull())).alias(f"_{c}"))
    pairs = pairs.join(sets(right, right_key, "y"), "y").join(sets(left, left_key, "x"), "x").withColumn("common", F.size(F.array_intersect("_x", "_y")))
    pairs = pairs.where(F.col("common") >= share * F.least(F.size("_x"), F.size("_y")))
    return pairs.select(F.col("x").alias(left_key), F.col("y").alias(right_key), F.col("common").cast("long").alias("common"))


def _past(few: DataFrame, left_key: str, right: DataFrame, right_key: str, items: str, share: float) -> DataFrame:
    """``overlapping`` with the few sets (left_key, _i) broadcast as an inverted index."""
    table = few.toArrow()  # FEW_ITEMS items at most
    schema = StructType([few.schema[left_key], right.schema[right_key], StructField("common", LongType())])
    if not table.num_rows:
        return right.sparkSession.createDataFrame([], schema)
    held = table.column("_i").combine_chunks()
    coded = held.flatten().dictionary_encode()
    size = pc.list_value_length(held).to_numpy().astype(np.int64)
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    postings = np.repeat(np.arange(len(size)), size)[order]
    often = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
    sent = right.sparkSession.sparkContext.broadcast((table.column(left_key).combine_chunks(), size, coded.dictionary, postings, np.cumsum(often) - often, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, size, words, postings, first, often = sent.value
        step = max(1, _CELLS // len(size))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                there, sets = part.column(0), part.column(1)
                row = pc.list_parent_indices(sets).to_numpy().astype(np.int64)
                flat = sets.flatten().dictionary_encode()
                known = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
                if not len(known):
                    continue
                n_words = len(flat.dictionary)
                each = np.unique(row[known] * n_words + flat.indices.take(pa.array(known)).to_numpy())  # items of a set once
                row, code = each // n_words, pc.index_in(flat.dictionary, words).fill_null(-1).to_numpy()[each % n_words]
                other = np.bincount(row, minlength=part.num_rows)
                row, code = row[code >= 0], code[code >= 0]
                made = np.cumsum(often[code])
                common = np.zeros(part.num_rows * len(size), np.int64)
                low = 0
                while low < len(code):
                    high = max(low + 1, int(np.searchsorted(made, (made[low - 1] if low else 0) + _CELLS, side="right")))
                    n = often[code[low:high]]
                    of = np.repeat(first[code[low:high]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    common += np.bincount(np.repeat(row[low:high], n) * len(size) + postings[of], minlength=len(common))
                    low = high
                common = common.reshape(part.num_rows, len(size))
                y, x = np.nonzero((common > 0) & (common >= share * np.minimum(other[:, None], size[None, :])))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)), there.take(pa.array(y)), pa.array(common[y, x])], names=[left_key, right_key, "common"])

    return written(right.where(F.col(right_key).isNotNull()).select(right_key, F.col(items)).mapInArrow(run, schema), "overlaps", BATCH)


def state_conflicts(rows: DataFrame, scope: str, key: str, member: str, state: str) -> DataFrame:
    """(scope, first, second, member, first_state, second_state): pairs of records (scope, key, member, state) of one scope
    that share a member in different states, with the smallest such member.  Null states agree with all; of rows that
    repeat a record's member the smallest state counts.  Work grows with the pairs that share a member within a scope."""
    each = rows.where(F.col(state).isNotNull() & F.col(member).isNotNull()).groupBy(scope, member, key).agg(F.min(state).alias(state))
    side = lambda k, s: each.select(scope, member, F.col(key).alias(k), F.col(state).alias(s))
    met = side("first", "first_state").join(side("second", "second_state"), [scope, member]).where("first < second and first_state <> second_state")
    least = met.groupBy(scope, "first", "second").agg(F.min(F.struct(member, "first_state", "second_state")).alias("_m"))
    return least.select(scope, "first", "second", f"_m.{member}", "_m.first_state", "_m.second_state")


def place_conflicts(rows: DataFrame, scope: str, key: str, member: str, place: str) -> DataFrame:
    """(scope, first, second, first_place, second_place, members): pairs of records (scope, key, member, place) of one scope
    at different places, with the members that they share, in order.  Null places agree with all."""
    each = rows.where(F.col(place).isNotNull() & F.col(member).isNotNull()).select(scope, member, key, place).distinct()
    side = lambda k, p: each.select(scope, member, F.col(key).alias(k), F.col(place).alias(p))
    met = side("first", "first_place").join(side("second", "second_place"), [scope, member]).where("first < second and first_place <> second_place")
    return met.groupBy(scope, "first", "second", "first_place", "second_place").agg(F.sort_array(F.collect_set(member)).alias("members"))


def used_before(text: Column, use: str, trigger: str) -> Column:
    """Whether ``use`` stands in the text before ``trigger`` first does; false if either is missing, null for null."""
    at, then = F.instr(text, use), F.instr(text, trigger)
    return (at > 0) & (then > 0) & (at < then)
