"""Benchmark decontamination by winnowing.

Every word k-gram gets a hash; of each run of w consecutive k-grams the smallest hash is kept as a fingerprint, so any
shared span of k + w - 1 words has a fingerprint in common.  Corpus fingerprints are joined with those of the
benchmark, and each hit is extended over the neighbouring words to whole windows of k + w - 1 item words.

Defined results: a null or empty text has no words and no hits; an item with fewer words than a window, but some, is one
window; an item that is null or has no words never occurs; repeated corpus rows are judged one by one; repeated
items count once; the words of an item whose item_id is null are hit, but it is not reported.  Only the key and the
text are read; other columns pass unused.

The benchmark is a stated query set.  It is read in blocks of at most ``block_items`` items and about ``block_bytes``
bytes (or one longer item); each block in turn is broadcast and held against all rows, which carry their hits along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import words as W
from lexiforge.llm.common import materialise, table

WINDOW = 10
KGRAM = 5
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 16 << 20


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the fingerprints among the k-gram hashes ``h``: the rightmost minimum of each run of w."""
    n = len(h)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(h[::-1]))] if n else [], np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(h[::-1], w)
    at = n - 1 - (np.argmin(runs, axis=1) + np.arange(len(runs)))
    return np.unique(at)


@dataclass
class Block:
    """Some benchmark items, ready to be looked up: fingerprints, and per window length the windows' hashes."""

    names: list[str | None]
    window: int
    k: int
    fingerprints: np.ndarray = field(default_factory=lambda: np.zeros(0, W.U64))
    windows: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # length: sorted hashes, items

    @classmethod
    def build(cls, names: list[str | None], texts: list[str | None], window: int, k: int) -> Block:
        block, prints, found = cls(names, window, k), [], {}
        for item, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h = W.scan(raw, np.array([0, len(raw)]), W.PUNCT, lower=True).hashes()
            if not len(h):
                continue
            size = min(window, len(h))
            spans = np.unique(W.grams(h, size))
            found.setdefault(size, []).append((spans, np.full(len(spans), item)))
            if size == window:
                g = W.grams(h, k)
                prints.append(g[winnow(g, window - k + 1)])
        if prints:
            block.fingerprints = np.unique(np.concatenate(prints))
        for size, parts in found.items():
            h, items = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((items, h))
            block.windows[size] = h[order], items[order]
        return block

    def extended(self, h: np.ndarray) -> np.ndarray:
        """Starts of all full windows that hold one of the text's fingerprints that the benchmark has too."""
        w = self.window - self.k + 1
        g = W.grams(h, self.k)
        at = winnow(g, w)
        at = at[W.is_in(g[at], self.fingerprints)]
        starts = np.unique((at[:, None] - np.arange(w)).ravel())
        return starts[(starts >= 0) & (starts <= len(h) - self.window)]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """For the word hashes of one text: how many occurring windows begin (+) and end (-) at each word, and items."""
        turns, items = np.zeros(len(h) + 1, np.int64), set()
        for size, (known, owner) in self.windows.items():
            if len(h) < size:
                continue
            starts = self.extended(h) if size == self.window else np.arange(len(h) - size + 1)
            spans = W.grams_at(h, starts, size)
            hit = W.is_in(spans, known)
            starts, spans = starts[hit], np.unique(spans[hit])
            np.add.at(turns, starts, 1)
            np.add.at(turns, starts + size, -1)
            for a, b in zip(np.searchsorted(known, spans), np.searchsorted(known, spans, side="right"), strict=True):
                items.update(owner[a:b].tolist())
        return turns, items


def read_blocks(benchmark: DataFrame, window: int, k: int, block_items: int, block_bytes: int) -> Iterator[Block]:
    names: list[str | None] = []
    texts: list[str | None] = []
    size = 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").distinct().toLocalIterator():
        if names and (len(names) >= block_items or size + len(text or "") > block_bytes):
            yield Block.build(names, texts, window, k)
            names, texts, size = [], [], 0
        names.append(name)
        texts.append(text)
        size += len(text or "")
    yield Block.build(names, texts, window, k)


def hold_against(rows: DataFrame, key: str, block: Block) -> DataFrame:
    """Adds a block's hits to (key, text, n_words, spans, items); spans are hit words as [from, to, from, to ...)."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        short = any(size != block.window for size in block.windows)
        for batch in batches:
            for at, to, data, offsets in W.chunks(batch.column(1)):
                w = W.scan(data, offsets, W.PUNCT, lower=True)
                h = w.hashes()
                part = batch.slice(at, to - at)
                spans, items = part.column(3).to_pylist(), part.column(4).to_pylist()
                # texts none of whose k-grams the benchmark has are passed over together
                near = np.flatnonzero(W.is_in(W.grams(h, block.k), block.fingerprints))
                some = np.arange(w.texts) if short else np.unique(np.searchsorted(w.first, near, side="right") - 1)
                for i in some.tolist():
                    turns, found = block.look_up(h[w.first[i] : w.first[i + 1]])
                    if not found:
                        continue
                    np.add.at(turns, spans[i][::2], 1)
                    np.add.at(turns, spans[i][1::2], -1)
                    inside = np.concatenate(([False], np.cumsum(turns) > 0))
                    spans[i] = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
                    items[i] = sorted({*items[i], *(n for j in found if (n := block.names[j]) is not None)})
                columns = [part.column(0), part.column(1), pa.array(w.counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, k: int = KGRAM, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, carry: bool = False
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated; with ``carry`` instead
    ``row``, a struct of the columns of ``docs``, and contaminated."""
    payload = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.col(f"`{key}`")
    rows = docs.select(payload.alias("key"), "text", F.lit(0).cast("long").alias("n_words"), F.expr("array()").cast("array<int>").alias("spans"), F.expr("array()").cast("array<string>").alias("items"))
    for i, block in enumerate(read_blocks(benchmark, window, k, block_items, block_bytes)):
        rows = hold_against(materialise(rows, "hits") if i else rows, "key", block)
    hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")
    if carry:
        return rows.select(F.col("key").alias("row"), (F.size("spans") > 0).alias("contaminated"))
    return rows.select(
        F.col("key").alias(key), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    return contamination(docs, benchmark, carry=True).where(~F.col("contaminated")).select("row.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
