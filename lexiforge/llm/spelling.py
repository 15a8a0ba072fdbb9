"""Spelling variants: words that differ in one code point, found by a dictionary of pairs of trie nodes.

The nodes of a trie of the words and of a trie of the reversed words are numbered.  A word is cut at each position into
the node of what comes before and the node of what comes after:

* skipping a position gives (prefix node, suffix node) of all but one code point; two words that share such a pair differ
  in that code point only;
* skipping nothing gives (prefix node, suffix node) of the whole word; a word that has this pair when it skips a position
  is the word with one code point inserted there.

So equal integer pairs are exactly the neighbours, and nothing is verified afterwards.  A pair of nodes has one word for
each code point of the alphabet at most and one more, and every word takes from it a count and the best of the others, so
that no pairs of words are emitted.

The tries are numbered in ranges of the sorted words: a task walks its words in order and numbers the nodes that the last
word did not have.  Only prefixes of the words at which ranges are cut can be nodes of two ranges; the driver numbers
these (4,096 ranges at most).  A word of any length costs as many integers as it has code points.

Defined results: a null text has no words; a null doc_id is written as the empty string before the colon; rows that repeat
a doc_id count each; a run that loses its last code point is no word; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch, table

RUN = "[a-zÀ-ÿ]+"
#: One run of a document in so many is misspelt by the rule of the data.
EVERY = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form is used so many times as often, at least.
RATIO = 2
#: Words that a task has counted before it passes them on.
_HELD = 200_000
#: Words of a range of the sorted vocabulary, the most ranges, and words drawn for each to cut them evenly.
RANGE_WORDS, MAX_RANGES, _DRAWN = 50_000, 4096, 50
#: Words that one task cuts at all positions.
_CUT_WORDS = 20_000
#: Words of one file of the tables that are written between the steps.
_FILE_WORDS = 50_000


def as_written(doc_id: int | None, run: str) -> str:
    """The run as it stands, or without one of its code points if the checksum of the document and the run says so."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all documents that are long and frequent enough."""
    runs = re.compile(RUN).findall

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text:
                    for run, n in Counter(runs(text.encode().lower().decode())).items():  # of bytes: A-Z only
                        word = as_written(doc_id, run)
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) >= _HELD:
                        yield rows(held)
                        held.clear()
        yield rows(held)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def files(spark: SparkSession, count: int) -> int:
    """How many files a table of ``count`` words is written to, however many partitions its joins were dealt to.  Hadoop
    without native code starts processes for each local file, and small files are read slowly."""
    return max(spark.sparkContext.defaultParallelism, -(-count // _FILE_WORDS))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:  # prefixes up to low are equal
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def shared_paths(cuts: list[str]) -> list[list[int]]:
    """The nodes of the words at which ranges are cut, numbered from 1; 0 is the root."""
    paths, last, used = [], "", 0
    for word in cuts:
        same = common_prefix(last, word)
        path = (paths[-1] if paths else [0])[: same + 1]
        path += range(used + 1, used + 1 + len(word) - same)
        used += len(word) - same
        paths.append(path)
        last = word
    return paths


class Numbering:
    """Numbers the trie nodes of the sorted words of one range."""

    def __init__(self, number: int, cuts: list[str], paths: list[list[int]]) -> None:
        edges = [i for i in (number - 1, number) if 0 <= i < len(cuts)]
        self.edges = [(cuts[i], paths[i]) for i in edges]
        self.used = (number + 1) << 40
        self.word, self.path = "", [0]

    def next(self, word: str) -> list[int]:
        """The nodes of all prefixes of ``word``, the empty one first."""
        path = [0]
        for cut, nodes in self.edges:
            same = common_prefix(cut, word)
            if same >= len(path):
                path = nodes[: same + 1]
        same = common_prefix(self.word, word)
        path = path + self.path[len(path) : same + 1]
        new = len(word) + 1 - len(path)
        path += range(self.used, self.used + new)
        self.used += new
        self.word, self.path = word, path
        return path


def trie_nodes(words: DataFrame, count: int, range_words: int = RANGE_WORDS) -> DataFrame:
    """(word, place, nodes) for distinct ``words`` (word): the place orders words by code points; nodes[i] is the trie
    node of the first i code points, the same for all words that share them."""
    ranges = max(1, min(MAX_RANGES, -(-count // range_words)))
    every = max(1, count // (ranges * _DRAWN))
    drawn = sorted(r.word for r in words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").toLocalIterator()) if ranges > 1 else []
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    shared = words.sparkSession.sparkContext.broadcast((cuts, shared_paths(cuts)))

    @F.pandas_udf("int")
    def range_of(word: pd.Series) -> pd.Series:
        at = shared.value[0]
        return pd.Series([bisect_right(at, w) for w in word], dtype="int32")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, paths = shared.value
        of, numbering, row = None, None, 0
        for batch in batches:
            nodes, places = [], []
            for k, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != of:
                    of, numbering, row = k, Numbering(k, cuts, paths), 0
                nodes.append(numbering.next(word))
                places.append((k << 40) + row)
                row += 1
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(places, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["word", "place", "nodes"])

    dealt = words.select(range_of("word").alias("range"), "word").repartitionById(len(cuts) + 1, F.col("range"))
    return dealt.sortWithinPartitions("range", "word").mapInArrow(number, "word string, place long, nodes array<long>")


def neighbours(words: DataFrame, count: int, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """For distinct ``words`` (word, n): the words with their places, and per place (place, n_near, best_n, best) of
    those that have neighbours: how many, and count and place of the most frequent one (ties: the smallest)."""
    spark = words.sparkSession
    tables = Scratch(spark)
    forward = trie_nodes(words.select("word"), count, range_words).withColumnRenamed("nodes", "prefix")
    backward = trie_nodes(words.select(F.reverse("word").alias("word")), count, range_words).select(F.reverse("word").alias("word"), F.col("nodes").alias("suffix"))
    n_files = files(spark, count)
    placed = tables.write(words.join(forward, "word").join(backward, "word").coalesce(n_files), "placed")
    size = F.size("prefix") - 1
    letter = lambda i: F.substring("word", i + 1, F.lit(1))
    skip = lambda i: F.struct(F.get("prefix", i).alias("p"), F.get("suffix", size - i - 1).alias("s"), F.lit(True).alias("skip"), ((i == 0) | (letter(i) != letter(i - 1))).alias("first"))
    whole = lambda i: F.struct(F.get("prefix", i).alias("p"), F.get("suffix", size - i).alias("s"), F.lit(False).alias("skip"), F.lit(False).alias("first"))
    cuts = F.concat(F.transform(F.sequence(F.lit(0), size - 1), skip), F.transform(F.sequence(F.lit(0), size), whole))
    # a row becomes some twenty
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // _CUT_WORDS)
    cut = placed.repartition(tasks, "place").select("n", "place", F.explode(cuts).alias("c")).select("c.*", "n", "place")
    # most frequent first, then the smallest word; ``first`` marks the first of equal code points, so that a pair of words
    # which can be had by skipping any of them counts once
    pair = cut.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("place")).alias("order"), "skip", "first")), False).alias("found"))
    pair = pair.where(F.size("found") > 1)
    skips = F.size(F.filter("found", lambda m: m["skip"]))
    firsts = F.size(F.filter("found", lambda m: m["first"]))
    pair = pair.select("found", skips.alias("skips"), firsts.alias("firsts"), (F.size("found") > skips).cast("int").alias("has_whole"))
    each = F.transform("found", lambda m, i: F.struct(
        (-m["order"]).alias("place"),
        F.when(m["skip"], F.col("skips") - 1 + F.when(m["first"], F.col("has_whole")).otherwise(0)).otherwise(F.col("firsts")).alias("near"),
        F.get("found", F.when(i == 0, 1).otherwise(0)).alias("best"),
    ))
    near = pair.select(F.explode(each).alias("e")).groupBy("e.place").agg(F.sum("e.near").alias("n_near"), F.max(F.struct("e.best.n", "e.best.order")).alias("best"))
    near = near.select("place", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.order")).alias("best"))
    return placed.select("word", "n", "place"), tables.write(near.coalesce(n_files), "near")


def roots(links: DataFrame) -> DataFrame:
    """(place, root) for ``links`` (place, to) without cycles: where following them ends.  Each round doubles the
    length of what is followed, so that chains of forms, which double their counts, end after six rounds."""
    tables = Scratch(links.sparkSession)
    now = tables.write(links.select("place", F.col("to").alias("root")), "roots")
    n_files = files(links.sparkSession, now.count())
    while True:
        onward = now.select(F.col("place").alias("root"), F.col("root").alias("onward"))
        moved = now.join(onward, "root", "left").select("place", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        moved = tables.write(moved.coalesce(n_files), "roots")
        tables.drop(now)
        now = moved
        if now.where("moved").isEmpty():
            return now.select("place", "root")


def variants(words: DataFrame, ratio: int = RATIO, range_words: int = RANGE_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for distinct ``words`` (word, n)."""
    tables = Scratch(words.sparkSession)
    words = tables.write(words.select("word", "n"), "words")
    count = words.count()
    n_files = files(words.sparkSession, count)
    placed, near = neighbours(words, count, range_words)
    known = placed.join(near, "place", "left").withColumn("to", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")))
    known = tables.write(known.coalesce(n_files), "known")
    rooted = roots(known.where("to is not null").select("place", "to"))
    named = lambda place, word: known.select(F.col("place").alias(place), F.col("word").alias(word))
    out = known.join(rooted, "place", "left").join(named("to", "form"), "to", "left").join(named("root", "_root"), "root", "left")
    tables.drop(words)
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form",
        F.when(F.col("to").isNotNull(), F.col("best_n")).alias("form_n"), F.coalesce("_root", "word").alias("root"),
    ).coalesce(n_files)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # words are fewer than the bytes they are read from: not more files than parts of the input
    return variants(word_counts(docs).coalesce(max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())))
