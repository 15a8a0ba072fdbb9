"""Language-model scores by a log-bilinear model that is trained by noise-contrastive estimation.

The model gives a token, given the two before it, the probability

    P(word | before) = P(class | before) * P(word | class)

with the classes' part log-bilinear: each class has a vector and a bias as the next token and a vector for each of the two
places before it, and log P(class | c1, c2) = (first[c1] + second[c2]) . next[class] + bias[class] - log Z(c1, c2).  As
the exponent is a sum over the places, Z of all pairs of contexts is one product of two matrices, and every probability
is normalised exactly.  The end token and the ``OWN`` - 1 most frequent words are classes of their own; all other words,
known or not, are in one of ``ENDINGS`` classes by their last three bytes.  Within such a class a known word has the share
of its count and the unknown ones together have the share of Good and Turing, so the probabilities of all known words and
of one unknown word a class sum to one.

* Counts cover all training tokens.  Only words of a count that at most ``HEAD_WORDS`` reach are broadcast; the others
  are joined to their counts by a shuffle, and add to a document's sums.
* Every training token is learned from once, in ``ROUNDS`` rounds that share out the documents.  In a round every task
  trains numpy arrays on its part of them, starting from the same values; the results are averaged by their numbers of
  tokens, in a tree on the executors.  Size of
  model: 2048 classes of 3 * 16 + 1 numbers, however large the corpus.

Defined results: a null or empty text is one end token; a null doc_id has the checksum of the empty string (so it is
trained on); rows that repeat a doc_id are scored and counted each; with no training documents N and V are 0 and the model
is the one it starts from; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import blocks
from lexiforge.llm.common import Scratch, table

#: Classes of single words (0 is the end token), and classes by the endings of words.
OWN, ENDINGS = 1536, 512
CLASSES = OWN + ENDINGS
#: Numbers of a vector, noise classes that a batch of tokens shares, tokens of a batch, and of the pool a batch is drawn from.
WIDTH, NOISE, BATCH, POOL = 16, 64, 2048, 1 << 18
#: Rounds that share out the documents, the rate of learning, and what sums of squared gradients start from.
ROUNDS, RATE, DAMPING = 2, 0.1, 10.0
#: The most words whose counts are broadcast.
HEAD_WORDS = 1 << 18
#: Distinct words that a task holds before it passes their counts on.
_HELD = 300_000
_BLOCK = 8192


def tokens(text: str | None) -> list[bytes]:
    """The lower-cased words; of bytes, so that only A-Z and the six ASCII separators count."""
    return (text or "").encode().lower().split()


def ending(word: bytes) -> int:
    return OWN + crc32(word[-3:]) % ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end token is the empty word."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                held[b""] += 1
                if len(held) >= _HELD:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What is known of the training words.  ``counts`` (word, n) is the whole table; the rest is of bounded size."""

    counts: DataFrame
    train_tokens: int
    words: int
    ends: int
    least: int  # words of this count and more are in ``head``
    head: dict[bytes, int]  # number of the word in the arrays
    head_n: np.ndarray
    head_class: np.ndarray
    class_tokens: np.ndarray
    class_once: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        band = F.floor(F.log2("n") * 8)
        bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least"), F.max(F.when(F.length("word") == 0, F.col("n"))).alias("ends"))
        bands = sorted(bands.collect(), key=lambda r: -r.band)  # a few hundred rows
        least, held = (bands[0].least if bands else 0) + 1, 0
        for b in bands:
            held += b.words
            if held > HEAD_WORDS:
                break
            least = b.least
        frequent = counts.where(F.col("n") >= least).where(F.length("word") > 0).select("n", "word").toArrow()  # HEAD_WORDS at most
        head = sorted(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        numbered = {w: i for i, (_, w) in enumerate(head)}
        classes = np.array([i + 1 if i < OWN - 1 else ending(w) for i, (_, w) in enumerate(head)], np.uint16)
        n = np.array([x for x, _ in head], np.int64)
        ends = max((b.ends or 0 for b in bands), default=0)
        total, once = _class_totals(counts, set(list(numbered)[: OWN - 1]))
        own = min(len(head), OWN - 1)
        total[0], total[1 : own + 1] = ends, n[:own]
        return cls(counts, sum(b.tokens for b in bands), sum(b.words for b in bands), ends, least, numbered, n, classes, total, once)

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """By class the log10 of what a known word's count is multiplied with, and of the unknown words' share."""
        unknown = (self.class_once + 1.0) / (self.class_tokens + 2.0)
        share = np.log10((1 - unknown) / np.maximum(self.class_tokens, 1))
        share[:OWN] = -np.log10(np.maximum(self.class_tokens[:OWN], 1))
        return share, np.log10(unknown)


def _class_totals(counts: DataFrame, own: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each class of endings, and its words that were seen once."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, once = shared.value, np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w and w not in known:
                    c = ending(w)
                    total[c] += n
                    once[c] += n == 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"class": pa.array(at, pa.int32()), "total": pa.array(total[at]), "once": pa.array(once[at])})

    sums = counts.mapInArrow(add, "class int, total long, once long").groupBy("class").agg(F.sum("total").alias("total"), F.sum("once").alias("once"))
    total, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums.collect():  # a row a class
        total[r["class"]], once[r["class"]] = r["total"], r["once"]
    return total, once


ENCODED = "row long, doc_id long, trained boolean, n_tokens long, known long, base double, within double, classes binary, tail array<struct<word:binary,class:int,k:int>>"


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row of ``docs`` (doc_id, trained, text) the classes of its tokens, sums over the tokens that are broadcast (the
    log10 of their counts and one, and of their share of their class), and the others, each with its class and count."""
    v, (share, _) = vocabulary, vocabulary.within()
    log_c1 = np.append(np.log10(v.head_n + 1.0), 0.0)
    within = np.append(np.log10(v.head_n.astype(float)) + share[v.head_class], 0.0)
    end = (1 if v.ends else 0), float(np.log10(v.ends + 1.0)), 0.0
    shared = docs.sparkSession.sparkContext.broadcast((v.head, np.append(v.head_class, 0).astype(np.uint16), log_c1, within))
    names = ["row", "doc_id", "trained", "n_tokens", "known", "base", "within", "classes", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes, log_c1, within = shared.value
        get = head.get
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(3):
                found = tokens(text.as_py())
                at = np.fromiter((get(t, -1) for t in found), np.int64, len(found))
                out = np.zeros(len(found) + 1, np.uint16)
                out[:-1] = classes[at]
                tail: Counter = Counter()
                missing = np.flatnonzero(at < 0)
                for i in missing.tolist():
                    out[i] = ending(found[i])
                    tail[found[i], int(out[i])] += 1
                row = (len(found) + 1, len(found) - len(missing) + end[0], log_c1[at].sum() + end[1], within[at].sum() + end[2], out.tobytes(), [{"word": w, "class": c, "k": k} for (w, c), k in tail.items()])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("class", pa.int32()), ("k", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "trained", "text").mapInArrow(run, ENCODED)


@dataclass
class Network:
    """Vectors of the classes at the three places, and biases; each with its sums of squared gradients."""

    values: list[np.ndarray]
    squares: list[np.ndarray]

    SHAPES = ((CLASSES, WIDTH), (CLASSES, WIDTH), (CLASSES, WIDTH), (CLASSES,))

    @classmethod
    def start(cls, shares: np.ndarray) -> Network:
        rng = np.random.default_rng(1)
        values = [rng.normal(0, 0.1, s).astype(np.float32) for s in cls.SHAPES[:3]]
        return cls([*values, np.log(shares).astype(np.float32)], [np.full(s, DAMPING, np.float32) for s in cls.SHAPES])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.values, *self.squares)]).astype(np.float64)

    @classmethod
    def unflat(cls, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for s in cls.SHAPES * 2:
            size = int(np.prod(s))
            parts.append(flat[at : at + size].reshape(s).astype(np.float32))
            at += size
        return cls(parts[:4], parts[4:])

    def _step(self, i: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """One step for the rows of array ``i``, with the gradients of equal rows added up."""
        order = rows.argsort(kind="stable")
        rows = rows[order]
        last = np.append(np.flatnonzero(rows[1:] != rows[:-1]), len(rows) - 1)
        sums = gradient[order].cumsum(0)[last]
        sums[1:] -= sums[:-1].copy()
        at = rows[last]
        square = self.squares[i][at] + sums * sums
        self.squares[i][at] = square
        np.sqrt(square, out=square)
        sums *= np.float32(RATE)
        sums /= square
        self.values[i][at] -= sums

    def learn(self, c1: np.ndarray, c2: np.ndarray, target: np.ndarray, noise: np.ndarray, expected: np.ndarray) -> None:
        """One step of noise-contrastive estimation.  ``noise`` are the classes drawn for the whole batch; ``expected`` by
        class the log of how many noise tokens of that class come with a token."""
        following, first, second, bias = self.values
        h = first[c1]
        h += second[c2]
        vectors, against = following[target], following[noise]
        miss = 1 / (1 + np.exp(expected[target] - np.einsum("ij,ij->i", h, vectors) - bias[target])) - 1
        false = h @ against.T
        np.subtract(expected[noise] - bias[noise], false, out=false)
        np.exp(false, out=false)
        false += 1
        np.reciprocal(false, out=false)
        vectors *= miss[:, None]
        vectors += false @ against
        known = np.concatenate([target, noise])
        self._step(0, known, np.concatenate([miss[:, None] * h, false.T @ h]))
        self._step(3, known, np.concatenate([miss, false.sum(0)]))
        self._step(1, c1, vectors)
        self._step(2, c2, vectors)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (class one before, class), by (class two before, class), and log Z by (one before, two before)."""
        following, first, second, bias = self.values
        a, b = first @ following.T, second @ following.T + bias
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.exp(a - top_a) @ np.exp(b - top_b).T
        np.log(np.maximum(z, np.finfo(np.float32).tiny, out=z), out=z)
        z += top_a
        z += top_b.T
        return a, b, z


def contexts(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one before, two before, token) for all tokens of the sequences; before a sequence stand end tokens."""
    size = np.array([len(s) for s in sequences])
    whole = np.zeros(size.sum() + 2 * len(size), np.uint16)
    begin = np.cumsum(size + 2) - size
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    whole[at] = np.concatenate(sequences)
    return whole[at - 1], whole[at - 2], whole[at]


def trained(rows: DataFrame, shares: np.ndarray, rounds: int = ROUNDS) -> Network:
    """The network after ``rounds`` rounds that take a share of ``rows`` (row, classes) each.  ``shares`` are the classes' shares of all
    tokens: the noise, and what the biases start from."""
    spark = rows.sparkSession
    network = Network.start(shares)
    length, tasks = len(network.flat()) + 1, rows.rdd.getNumPartitions()
    cumulated, expected = np.cumsum(shares), np.log(NOISE * shares).astype(np.float32)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((network, cumulated, expected))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            rng, (start, cumulated, expected) = np.random.default_rng(part), shared.value
            own, seen = Network.unflat(start.flat()), 0

            def use(sequences: list[np.ndarray]) -> None:
                c1, c2, target = contexts(sequences)
                order = rng.permutation(len(target))
                for i in range(0, len(order), BATCH):
                    of = order[i : i + BATCH]
                    noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), CLASSES - 1).astype(np.uint16)
                    own.learn(c1[of], c2[of], target[of], noise, expected)

            pool, size = [], 0
            for batch in batches:
                for x in batch.column(0):
                    pool.append(np.frombuffer(x.as_py(), np.uint16))
                    size += len(pool[-1])
                    if size >= POOL:
                        use(pool)
                        seen, pool, size = seen + size, [], 0
            if pool:
                use(pool)
                seen += size
            if seen:
                yield from blocks.cut(part, np.append(own.flat(), 1.0) * seen, _BLOCK)

        sums = blocks.merged(rows.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).select("classes").mapInArrow(learn, blocks.KIND), tasks, length, np.float64, _BLOCK, np.add)
        if sums[-1]:
            network = Network.unflat(sums[:-1] / sums[-1])
    return network


_TABLES: dict[int, tuple[np.ndarray, ...]] = {}


def class_scores(rows: DataFrame, network: Network) -> DataFrame:
    """``rows`` without classes, with the log10 probability of their classes."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    key = id(shared)
    kept = [c for c in rows.columns if c not in ("classes", "tail")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TABLES:  # once in a Python worker
            _TABLES.clear()
            _TABLES[key] = shared.value.tables()
        by_first, by_second, z = _TABLES[key]
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            sequences = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(batch.num_columns - 1)]
            ends = np.cumsum([len(s) for s in sequences])
            at = 0
            while at < len(sequences):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POOL)))
                c1, c2, target = contexts(sequences[at:to])
                each = (by_first[c1, target] + by_second[c2, target] - z[c1, c2]).astype(np.float64)
                scores[at:to] = np.add.reduceat(each, np.append(0, ends[at : to - 1] - (ends[at - 1] if at else 0)))
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores / np.log(10))], names=[*kept, "class_score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.select(*kept, "classes").mapInArrow(run, f"{kinds}, class_score double")


def tail_sums(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """(row, tail_known, tail_base, tail_within): the sums over the words that are not broadcast."""
    share, unknown = v.within()
    by_class = rows.sparkSession.createDataFrame([(c, float(share[c]), float(unknown[c])) for c in range(CLASSES)], "class int, share double, unknown double")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.class", "t.k").join(F.broadcast(by_class), "class")
    rare = v.counts.where(F.col("n") < v.least)
    found = tail.join(rare.hint("merge"), "word", "left")
    known = F.col("n").isNotNull()
    return found.groupBy("row").agg(
        F.sum(F.when(known, F.col("k")).otherwise(0)).cast("long").alias("tail_known"),
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("tail_base"),
        F.sum(F.col("k") * F.when(known, F.log10(F.col("n").cast("double")) + F.col("share")).otherwise(F.col("unknown"))).alias("tail_within"),
    )


def scored(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``; the model learns
    from the rows for which ``train`` is true."""
    tables = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("trained"), "text")
    counts = tables.write(word_counts(docs.where("trained")), "words")
    v = Vocabulary.of(counts)
    rows = tables.write(encoded(docs, v), "encoded")
    network = trained(rows.where("trained"), (v.class_tokens + 0.5) / (v.class_tokens.sum() + 0.5 * CLASSES))
    sums = tables.write(tail_sums(rows, v), "tails")
    scores = tables.write(class_scores(rows, network), "scores")
    tables.drop(rows, counts)
    none = lambda c: F.coalesce(c, F.lit(0))
    return scores.join(sums, "row", "left").select(
        "doc_id", "trained", "n_tokens", (F.col("known") + none("tail_known")).alias("n_known"), F.lit(v.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + none("tail_base") - F.col("n_tokens") * float(np.log10(v.train_tokens + v.words + 1))).alias("base_score"),
        (F.col("class_score") + F.col("within") + none("tail_within")).alias("score"),
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return scored(table(spark, sf_dir, "documents"), ~held_out).select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
