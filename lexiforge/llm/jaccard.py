"""Jaccard join on word n-gram sets by prefix filters under several global token orders.

Links are pairs of texts with 100 * |intersection| >= percent * |union|.  Tokens are put in several global orders, each
with tokens of many documents last and shuffled by another hash.  A linked pair shares a token among the first
n - ceil(percent * n / 100) + 1 of each set in *every* order, so candidates come from the first order and must meet in
all others before they are verified on the whole sets.

Texts with equal sets are one node.  Candidates are drawn in two steps that keep dense groups linear:

1. per token the node with the fewest rarer tokens before it leads; each node is verified against the leader with which
   it shares most tokens, and the links found are contracted to components;
2. pairs of *different* components are drawn in full: per token and size class the nodes outside its largest component
   meet all others, under the position bound of the prefix filter.  No pair of different sets that could be linked is
   left out; pairs within a component add nothing to the components.

The order uses counts over all documents, hashed to a fixed number of slots, so that it has a bounded size; it only
steers the work and never the result.

Defined results: a text that is null or has no words has an empty set and is linked with nothing; a text with fewer
words than n is one token, its whole word sequence; rows that repeat a doc_id are separate texts of that id; a null
doc_id is in no component; other columns pass unused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import words as W
from lexiforge.llm.common import Scratch, small_or_shuffled, table
from lexiforge.llm.components import components

WORDS = 3
PERCENT = 90
ORDERS = 3
SLOTS = 1 << 20
_BLOCK = 1 << 14
_FAN = 64
#: Nodes from which on a token is split by size classes.
_HOT = 512
#: Pairs of one node that are verified in one place.
_PARTNERS = 64


def token_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The set of each text, as sorted 64-bit hashes of its word k-grams."""
    w = W.scan(data, offsets, W.SPACE, lower=True)
    h = w.hashes()
    whole = W.grams(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        else:
            out.append(W.grams(h[a:b], b - a) ^ W.U64(b - a) if b > a else whole[:0])
    return out


def slot_counts(docs: DataFrame, k: int) -> np.ndarray:
    """In how many texts the tokens of each slot are, summed over all documents; SLOTS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column(0)):
                sets = token_sets(data, offsets, k)
                total += np.bincount((np.concatenate(sets) % W.U64(SLOTS)).astype(np.int64), minlength=SLOTS)
        part = TaskContext.get().partitionId()
        yield _blocks([(i, part, total[i * _BLOCK : (i + 1) * _BLOCK]) for i in range(SLOTS // _BLOCK)])

    def add(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in group.column(2).to_pylist())
        return pa.Table.from_batches([_blocks([(first["block"], first["part"] // _FAN, total)])])

    kind = "block int, part int, counts binary"
    parts = docs.select("text").rdd.getNumPartitions()
    sums = docs.select("text").mapInArrow(count, kind)
    while parts > 0:
        # a group adds up at most _FAN partial sums of fixed size
        sums = sums.groupBy("block", F.expr(f"part div {_FAN}").alias("_g")).applyInArrow(add, kind)
        parts = (parts - 1) // _FAN
    out = np.zeros(SLOTS, np.int64)
    for r in sums.collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.int64)
    return out


def _blocks(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([squeeze(r[2].tobytes()) for r in rows], pa.binary())], names=["block", "part", "counts"])


FEATURES = "doc_id long, row long, n int, node long, first array<long>, others array<array<int>>"


def features(docs: DataFrame, k: int, percent: int, orders: int) -> DataFrame:
    """Per text its set size, its node (a hash of the set) and the prefixes: of the first order the tokens, of the
    others 32-bit hashes.  Of texts with one set that a task sees together, one carries the prefixes."""
    counts = slot_counts(docs, k)
    ranks = np.floor(np.log2(counts + 1.0)).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        seeds = W.mix(np.arange(1, orders + 1, dtype=W.U64))
        for batch in batches:
            for at, to, data, offsets in W.chunks(batch.column(2)):
                part, seen = batch.slice(at, to - at), set()
                n, node, first, others = [], [], [], []
                named = part.column(0).is_valid().to_pylist()
                for s, has_id in zip(token_sets(data, offsets, k), named, strict=True):
                    key = int(np.uint64((int(W.mix(s).sum()) + len(s) * int(seeds[0])) % 2**64).view(np.int64)) if len(s) else 0
                    n.append(len(s))
                    node.append(key)
                    if not len(s) or not has_id or key in seen:
                        first.append(None)
                        others.append(None)
                        continue
                    seen.add(key)
                    size = len(s) + (-percent * len(s) // 100) + 1
                    weight = rank[(s % W.U64(SLOTS)).astype(np.int64)].astype(W.U64) << W.U64(56)
                    prefixes = []
                    for seed in seeds:
                        order = weight | (W.mix(s ^ seed) >> W.U64(8))
                        pick = np.argpartition(order, size - 1)[:size] if size < len(s) else np.arange(len(s))
                        prefixes.append(s[pick[np.argsort(order[pick], kind="stable")]])
                    first.append(prefixes[0].view(np.int64))
                    others.append([p.astype(np.uint32).view(np.int32) for p in prefixes[1:]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.list_(pa.int32())))],
                    names=["doc_id", "row", "n", "node", "first", "others"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(run, FEATURES)


def _dealt(tables: Scratch, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes in ``pairs`` with a row for each part that their partners are dealt to (the written table, and as it is to
    be joined), and the pairs with the parts ``part_x`` and ``part_y``.  A part has about _PARTNERS pairs of a node, so the
    leader of a large group is as many keys as its group needs."""
    ends = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node")))
    used = tables.write(ends.groupBy("node").agg((F.floor((F.count("*") - 1) / _PARTNERS) + 1).cast("int").alias("parts")), "used")
    hot = used.where("parts > 1")
    n_hot = hot.count()
    for c, other in (("x", "y"), ("y", "x")):
        of = hot.select(F.col("node").alias(c), F.col("parts").alias("_parts"))
        pairs = pairs.join(small_or_shuffled(of, n_hot), c, "left") if n_hot else pairs.withColumn("_parts", F.lit(None).cast("int"))
        pairs = pairs.withColumn(f"part_{c}", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    each = used.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return used, small_or_shuffled(each, each.count()), pairs


def verified(tables: Scratch, pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (x, y) of nodes whose sets are linked, worked out on the whole texts."""
    used, ends, dealt = _dealt(tables, pairs.select("x", "y"))
    places = tables.write(nodes.join(ends, "node").select("node", "part", "doc_id", "row"), "places")
    # both sides of a pair read the one shuffle that deals texts to nodes
    texts = docs.join(small_or_shuffled(places, places.count()), ["doc_id", "row"]).select("node", "part", "text").dropDuplicates(["node", "part"])
    side = lambda c: texts.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"), F.col("text").alias(f"text_{c}"))
    both = dealt.join(side("x"), ["x", "part_x"]).join(side("y"), ["y", "part_y"]).select("x", "y", "text_x", "text_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                left, right = ([s for _, _, data, offsets in W.chunks(part.column(c)) for s in token_sets(data, offsets, k)] for c in (2, 3))
                keep = []
                for a, b in zip(left, right, strict=True):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * common >= percent * (len(a) + len(b) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    links = tables.write(both.mapInArrow(run, "x long, y long"), "links")
    tables.drop(used, places)
    return links


def meeting(tables: Scratch, pairs: DataFrame, feats: DataFrame, orders: int) -> DataFrame:
    """The ``pairs`` whose prefixes share a token in each of the other orders too.  Only prefixes of nodes in ``pairs``
    are moved."""
    if orders < 2:
        return pairs
    used, ends, dealt = _dealt(tables, pairs)
    carried = feats.where("others is not null").select("node", "others").join(ends, "node").dropDuplicates(["node", "part"])
    side = lambda c: carried.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"), F.col("others").alias(f"_{c}"))
    both = dealt.join(side("x"), ["x", "part_x"]).join(side("y"), ["y", "part_y"])
    for i in range(orders - 1):
        both = both.where(F.arrays_overlap(F.col("_x")[i], F.col("_y")[i]))
    met = tables.write(both.select(*pairs.columns), "meeting")
    tables.drop(used, pairs)
    return met


def size_fits(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b).cast("long") >= percent * F.greatest(a, b).cast("long")


def room_for(n_x: str, pos_x: str, n_y: str, pos_y: str, percent: int) -> Column:
    """Whether two sets whose first common token is at these positions can still overlap as much as they must."""
    left = F.least(F.col(n_x) - F.col(pos_x), F.col(n_y) - F.col(pos_y)).cast("long")
    return left * (100 + percent) >= percent * (F.col(n_x) + F.col(n_y)).cast("long")


def linked_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) per row of ``docs``; component_id is the smallest doc_id that links
    reach.  ``row`` is a hash of the text."""
    return _linked(docs, k, percent, orders).drop("comp")


def _linked(docs: DataFrame, k: int, percent: int, orders: int = ORDERS) -> DataFrame:
    """``linked_components`` and ``comp``, one node of the component; null for rows in none."""
    tables = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    feats = tables.write(features(docs, k, percent, orders), "features")
    nodes = feats.where("n > 0 and doc_id is not null").groupBy("node", "n").agg(F.min(F.struct("doc_id", "row")).alias("_of")).select("node", "n", "_of.doc_id", "_of.row")
    nodes = tables.write(nodes, "nodes")
    mask = (1 << 47) - 1
    # dealt by token once: what is counted and what is kept name the same columns, so they read the same shuffle
    dealt = feats.where("doc_id is not null").select("node", "n", F.posexplode("first").alias("pos", "token")).where("token is not null").repartition("token")
    rank = F.least("pos", F.lit(32767)).cast("long") * (1 << 47) + F.col("node").bitwiseAND(mask)
    # a node has one place for a token, so a token whose ranks differ is shared
    shared = dealt.groupBy("token").agg(F.min(rank).alias("lead"), F.max(rank).alias("_last"), F.max("n").alias("_n")).where("lead < _last and _n > 0").select("token", "lead")
    postings = tables.write(dealt.join(shared.hint("merge"), "token"), "postings")

    # step 1: each node against its most common leader
    leaders = nodes.select(F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("node").bitwiseAND(mask).alias("lead"))
    # a pair's first common token comes first in both sets, so the least positions are those of one token
    star = postings.groupBy("node", "n", F.col("lead").bitwiseAND(mask).alias("lead")).agg(F.count("*").alias("count"), F.min("pos").alias("pos"), F.min(F.shiftright("lead", 47)).alias("pos_y"))
    star = star.join(leaders, "lead").where(F.col("node") != F.col("y")).where(size_fits("n", "n_y", percent) & room_for("n", "pos", "n_y", "pos_y", percent))
    star = star.groupBy("node").agg(F.max(F.struct("count", "y")).alias("_y")).select(F.col("node").alias("x"), F.col("_y.y").alias("y"))
    star = meeting(tables, tables.write(star, "leaders"), feats, orders)
    links = verified(tables, star, docs, nodes, k, percent)
    roots = components(links)

    # step 2: what may still join different components
    n_roots = roots.count()
    of = lambda df: df.join(small_or_shuffled(roots, n_roots), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    pairs = meeting(tables, tables.write(across(of(postings), percent), "across"), feats, orders)
    tables.drop(postings, star)
    if not pairs.isEmpty():
        more = verified(tables, pairs, docs, nodes, k, percent)
        roots = components(links.union(more))
        n_roots = roots.count()
    tables.drop(pairs, links)
    rooted = of(nodes)
    least = rooted.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "comp").select("node", "component_id", "comp")
    out = feats.select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), F.when(F.expr("n > 0 and doc_id is not null"), F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "comp")


def across(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of nodes of different components that share a token of their first prefixes at positions which leave
    room for the overlap they need.  The smaller set must have it within its first n * (100 - percent) / (100 + percent)
    tokens.  Pairs are drawn where the tokens lie; a token of many nodes is split by size classes, of which the larger
    set is sent to those that its position allows."""
    whole = postings.select("token", "node", "n", "pos", "comp").repartition("token").distinct()
    main = (
        whole.groupBy("token", "comp").count().groupBy("token").agg(F.count("*").alias("_comps"), F.sum("count").alias("nodes"), F.max(F.struct("count", "comp")).alias("_m"))
        .where("_comps > 1").select("token", "nodes", F.col("_m.comp").alias("main"))
    )
    p = whole.join(main.hint("merge"), "token").withColumn("is_main", F.col("comp") == F.col("main")).drop("main")
    room = (F.col("n") - F.col("pos")).cast("long") * (100 + percent)
    low, high = F.ceil(F.col("n") * percent / 100), F.least("n", F.floor(room / percent) - F.col("n"))
    # a pair's sizes lie in one class or in neighbouring ones
    size_class = lambda n: F.floor(F.log(n.cast("double")) / math.log(100 / min(percent, 95))).cast("int")
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "pos", "comp", "is_main")]
    small, large = p.where(room >= 2 * percent * F.col("n")), p.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    fits = (F.col("comp_x") != F.col("comp_y")) & ~(F.col("is_main_x") & F.col("is_main_y")) & (F.col("n_x") <= F.col("n_y")) & size_fits("n_x", "n_y", percent) & room_for("n_x", "pos_x", "n_y", "pos_y", percent)
    cold = small.where(F.col("nodes") < _HOT).select("token", *side("x")).join(large.where(F.col("nodes") < _HOT).select("token", *side("y")).hint("merge"), "token").where(fits)
    classes = F.explode(F.sequence(size_class(F.col("_low")), size_class(F.col("_high"))))
    hot = small.where(F.col("nodes") >= _HOT).select("token", size_class(F.col("n")).alias("size"), *side("x"))
    hot = hot.join(large.where(F.col("nodes") >= _HOT).select("token", classes.alias("size"), *side("y")), ["token", "size"]).where(fits)
    met = cold.union(hot.select(*cold.columns))
    return met.select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y")).distinct()


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Stands for a null id where one of each group is chosen: any other id goes before it.
_LAST_ID = (1 << 63) - 1


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of ``docs`` one row: that with the smallest doc_id (a null one comes last, and of equal ones that
    with the smallest hash of its text), and of rows that repeat both id and text any one.  Rows with empty sets all stay."""
    docs_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    found = _linked(docs.withColumn("doc_id", docs_id), k, percent).where("n_shingles > 0")
    first = found.groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("_first"))
    places = found.groupBy("comp", "doc_id", "row").agg(F.count("*").alias("_n"))
    # the rows of a large component are dealt out by their ids: a row stays if it is the first of any component
    places = places.join(first.select("comp", "_first.*").withColumn("_stays", F.lit(True)), ["comp", "doc_id", "row"], "left")
    gone = places.where("_stays is null").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    again = places.where("_stays and _n > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), docs_id.alias("_id"), F.xxhash64("text").alias("_row"))
    kept = keyed.join(gone, ["_id", "_row"], "left_anti")
    if again.isEmpty():
        return kept.select("doc.*")
    once = kept.join(again, ["_id", "_row"], "left_anti").select("doc")
    return once.union(kept.join(again, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select("doc")).select("doc.*")
