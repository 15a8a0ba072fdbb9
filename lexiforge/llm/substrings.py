"""Substring dedup by super-k-mers: removes word windows that also start in a document with a smaller id.

A window is k consecutive words; its minimiser is the smallest hash among its m-word grams.  Consecutive windows that
share a minimiser travel as one packed string, the slice of text they cover, to the minimiser's bucket, where sorting
brings equal windows together, counts them and finds the smallest document of each.

Before anything travels, a task settles what it can within a piece of about ``GROUP_BYTES`` of its input: of windows
that are equal there only those of the smallest document go on.  So a passage that a third of all documents share
reaches its bucket once a piece, not once a document.

Buckets are dealt to tasks by number, so that each task has equally many.  A bucket that grows over ``HOT_BYTES``, because
of a minimiser that very many windows share, is not settled where it lies: its strings are cut at a second minimiser under
another hash and dealt anew, which splits it over many tasks and keeps equal windows together.

Defined results: a null or empty text has no words and its hash is that of the empty string; a null doc_id is not
smaller than any other and none is smaller than it; rows that repeat a doc_id are separate, and neither removes words
from the other; a text of fewer than k words is kept whole; other columns pass unused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import words as W
from lexiforge.llm.common import GROUP_BYTES, Scratch, buckets_for, table

WINDOW = 13
MINIMISER = 4
LEVEL = 6

#: Bytes of text from which on a bucket is dealt anew, into so many parts a multiple of it.
HOT_BYTES = 16 * GROUP_BYTES
HOT_PARTS = 4096
#: Buckets a task has, as long as tasks are fewer than the next number.
TASK_BUCKETS = 2
MOST_TASKS = 100_000

FLAGS = "doc_id long, row long, low int, high int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, by doubling."""
    size = 1
    while size < w:
        step = min(size, w - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and last bytes of all words, and each text's first word; worked out a part at a time."""
    h, begin, end, first, total, at = [], [], [], [np.zeros(1, np.int64)], 0, 0
    while at < len(offsets) - 1:
        to = min(len(offsets) - 1, max(at + 1, int(np.searchsorted(offsets, offsets[at] + W.CHUNK_BYTES, side="right")) - 1))
        w = W.scan(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], W.SPACE)
        h.append(w.hashes())
        begin.append(w.begin + offsets[at])
        end.append(w.end + offsets[at])
        first.append(w.first[1:] + total)
        total += len(w.begin)
        at = to
    return np.concatenate(h), np.concatenate(begin), np.concatenate(end), np.concatenate(first)


def windows_of(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows, and the text of each."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[text], text


def smallest(h: np.ndarray, doc: np.ndarray, at: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows (hash, document, first word): a number for each group of equal windows, and the smallest document of
    the group.  Windows of one hash are compared word by word."""
    order = np.lexsort((doc, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    twin = np.flatnonzero(head != order)
    differs = np.zeros(len(twin), bool)
    for i in range(k):
        differs |= word[at[order[twin]] + i] != word[at[head[twin]] + i]
    if differs.any():  # two texts with one 64-bit hash: sort those by their words as well
        rank = np.unique(np.stack([word[at + i] for i in range(k)], axis=1), axis=0, return_inverse=True)[1].ravel()
        return smallest(rank.astype(W.U64), doc, at, np.zeros(len(word), W.U64), k)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, doc[order[new]]


def _runs(starts: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive ``starts`` along which ``same`` (between neighbours) holds: first and last index of each."""
    cut = np.ones(len(starts), bool)
    cut[1:] = (np.diff(starts) != 1) | ~same
    head = np.flatnonzero(cut)
    return head, np.append(head[1:], len(starts)) - 1


_HEAD = struct.Struct("<qqq")


def pack(docs: np.ndarray, rows: np.ndarray, settled: list[tuple[int, np.ndarray]], strings: list[bytes], places: np.ndarray) -> bytes:
    """Super-k-mers of a bucket: the texts they come from, windows already settled, (text, first word, bytes) of each
    string, and the strings."""
    lists = np.array([[i, len(s)] for i, s in settled], np.int64).reshape(-1, 2)
    flags = np.concatenate([s for _, s in settled]).astype(np.int32) if settled else np.zeros(0, np.int32)
    parts = [_HEAD.pack(len(docs), len(lists), len(places)), docs.tobytes(), rows.tobytes(), lists.tobytes(), flags.tobytes(), *(np.diff(c, prepend=0).astype(np.int32).tobytes() for c in places.T[:2]), places[:, 2].astype(np.int32).tobytes(), *strings]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, p = _HEAD.unpack_from(raw)
    at = _HEAD.size

    def take(count: int, kind) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    docs, rows, lists = take(n, np.int64), take(n, np.int64), take(2 * m, np.int64).reshape(-1, 2)
    flags = take(int(lists[:, 1].sum()), np.int32)
    places = np.stack((np.cumsum(take(p, np.int32), dtype=np.int64), np.cumsum(take(p, np.int32), dtype=np.int64), take(p, np.int32)), axis=1)
    return docs, rows, lists, flags, places, raw[at:]


def super_kmers(docs: DataFrame, buckets: int, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(bucket, packed) from (doc_id, row, text): per piece of input and bucket one packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(0)))
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for at, to, data, offsets in W.chunks(batch.column(2), GROUP_BYTES):
                out = _piece(ids[at:to], rows[at:to], data, offsets, buckets, k, m)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "packed"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "bucket long, packed binary")


def _piece(ids: np.ndarray, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, buckets: int, k: int, m: int) -> list[tuple[int, bytes]]:
    h, begin, end, first = word_hashes(data, offsets)
    starts, text = windows_of(first, k)
    if not len(starts):
        return []
    whole = W.grams_at(h, starts, k)
    group, least = smallest(whole, ids[text], starts, h, k)
    late = ids[text] > least[group]
    # of what is left, the first of equal windows in each text goes on
    order = np.lexsort((starts, text, group))
    order = order[~late[order]]
    lead = np.ones(len(order), bool)
    lead[1:] = (group[order[1:]] != group[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    go = np.sort(order[lead])
    key = sliding_min(W.grams(h, m), k - m + 1)[starts[go]]
    bucket = (W.mix(key) % W.U64(buckets)).astype(np.int64)
    head, tail = _runs(starts[go], (key[1:] == key[:-1]) & (text[go][1:] == text[go][:-1]))
    low, high = begin[starts[go[head]]], end[starts[go[tail]] + k - 1]
    owner, place = text[go[head]], starts[go[head]] - first[text[go[head]]]
    dealt = np.argsort(bucket[head], kind="stable")
    edges = np.flatnonzero(np.diff(bucket[head][dealt], prepend=-1))
    raw = data.tobytes()
    settled: dict[int, list[tuple[int, np.ndarray]]] = {}
    gone = np.flatnonzero(late)
    if len(gone):
        for part in np.split(gone, np.flatnonzero(np.diff(text[gone])) + 1):
            t = int(text[part[0]])
            settled.setdefault(int(W.mix(np.array([rows[t]]).astype(W.U64))[0] % W.U64(buckets)), []).append((t, starts[part] - first[t]))
    strings_of = {}
    for a, b in zip(edges, np.append(edges[1:], len(dealt)), strict=True):
        strings_of[int(bucket[head][dealt[a]])] = dealt[a:b]
    out = []
    for b in sorted({*strings_of, *settled}):
        pick = strings_of.get(b, np.zeros(0, np.int64))
        flags = settled.get(b, [])
        used, where = np.unique(np.concatenate((owner[pick], np.array([t for t, _ in flags], np.int64))), return_inverse=True)
        strings = [raw[x:y] for x, y in zip(low[pick].tolist(), high[pick].tolist(), strict=True)]
        places = np.stack((where[: len(pick)], place[pick], high[pick] - low[pick]), axis=1)
        flags = [(int(where[len(pick) + i]), s) for i, (_, s) in enumerate(flags)]
        out.append((b, pack(ids[used], rows[used], flags, strings, places)))
    return out


def _opened(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Documents and rows of packed strings, (text, window) pairs settled before, and owner, place and bytes of each string."""
    docs, rows, owner, place, texts, sizes, base, late = [], [], [], [], [], [], 0, []
    for blob in blobs:
        d, r, lists, flags, places, raw = unpack(blob)
        late.append(np.stack((np.repeat(lists[:, 0], lists[:, 1]) + base, flags.astype(np.int64)), axis=1))
        docs.append(d)
        rows.append(r)
        owner.append(places[:, 0] + base)
        place.append(places[:, 1])
        sizes.append(places[:, 2])
        texts.append(raw)
        base += len(d)
    return *map(np.concatenate, (docs, rows, late, owner, place, sizes)), np.frombuffer(b"".join(texts), np.uint8)


def _settled(blobs: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """The columns of FLAGS for the strings of one bucket."""
    docs, rows, late, owner, place, sizes, text = _opened(blobs)
    if len(owner):
        h, _, _, first = word_hashes(text, np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes))))
        starts, string = windows_of(first, k)
        doc = docs[owner[string]]
        number, least = smallest(W.grams_at(h, starts, k), doc, starts, h, k)
        found = np.flatnonzero(doc > least[number])
        late = np.concatenate((late, np.stack((owner[string[found]], (starts - first[string] + place[string])[found]), axis=1)))
    which, at = late[np.lexsort((late[:, 1], late[:, 0]))].T
    head, tail = _runs(at, which[1:] == which[:-1]) if len(at) else (at, at)
    return docs[which[head]], rows[which[head]], at[head].astype(np.int32), at[tail].astype(np.int32)


def _dealt_anew(bucket: int, blob: bytes, k: int, m: int) -> list[tuple[int, bytes]]:
    """The strings of a packed row, cut at a second minimiser and dealt to parts of the bucket."""
    docs, rows, late, owner, place, sizes, text = _opened([blob])
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    h, begin, end, first = word_hashes(text, offsets)
    starts, string = windows_of(first, k)
    raw, out = text.tobytes(), []
    if len(starts):
        key = sliding_min(W.mix(W.grams(h, m) ^ W.U64(0x5BD1E995)), k - m + 1)[starts]
        head, tail = _runs(starts, (key[1:] == key[:-1]) & (string[1:] == string[:-1]))
        low, high = begin[starts[head]], end[starts[tail] + k - 1]
        part = (W.mix(key[head]) % W.U64(HOT_PARTS)).astype(np.int64) + bucket * HOT_PARTS
        for b in np.unique(part).tolist():
            pick = np.flatnonzero(part == b)
            used, where = np.unique(owner[string[head[pick]]], return_inverse=True)
            at = starts[head[pick]] - first[string[head[pick]]] + place[string[head[pick]]]
            out.append((b, pack(docs[used], rows[used], [], [raw[x:y] for x, y in zip(low[pick].tolist(), high[pick].tolist(), strict=True)], np.stack((where, at, high[pick] - low[pick]), axis=1))))
    if len(late):
        late = late[np.lexsort((late[:, 1], late[:, 0]))]
        lists = [(int(x[0, 0]), x[:, 1]) for x in np.split(late, np.flatnonzero(np.diff(late[:, 0])) + 1)]
        out.append((bucket * HOT_PARTS, pack(docs, rows, lists, [], np.zeros((0, 3), np.int64))))
    return out


def settle(packed: DataFrame, buckets: int, k: int = WINDOW, m: int = MINIMISER, hot: int | None = None) -> DataFrame:
    """(doc_id, row, low, high): runs of windows, from the first word of the first to that of the last, that a smaller
    document has as well."""
    hot = HOT_BYTES if hot is None else hot
    tables = Scratch(packed.sparkSession)
    first = tables.write(_bucket_by_bucket(packed, buckets, k, m, hot), "settled")
    again = first.where("bucket is not null").select("bucket", "packed")
    if again.isEmpty():
        return first.select("doc_id", "row", "low", "high")
    rest = _bucket_by_bucket(again, buckets, k, m, None)
    return first.where("bucket is null").union(rest).select("doc_id", "row", "low", "high")


def _bucket_by_bucket(packed: DataFrame, buckets: int, k: int, m: int, hot: int | None) -> DataFrame:
    """The flags of each bucket; instead of those, (bucket, packed) of the parts of one that is over ``hot``."""
    names = ["doc_id", "row", "low", "high", "bucket", "packed"]
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("bucket", pa.int64()), ("packed", pa.binary())])

    def flags(blobs: list[bytes]) -> pa.RecordBatch:
        columns = _settled(blobs, k)
        none = len(columns[0])
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], schema=schema)

    def parts(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for blob in blobs:
            dealt = _dealt_anew(bucket, blob, k, m)
            n = len(dealt)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in schema.types[:4]), pa.array([b for b, _ in dealt], pa.int64()), pa.array([x for _, x in dealt], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size, over = None, [], 0, False
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket:
                    if held:
                        yield flags(held)
                    bucket, held, size, over = b, [], 0, False
                blob = blob.as_py()
                held.append(blob)
                size += zstandard.frame_content_size(blob)
                over = over or (hot is not None and size > hot)
                if over:
                    yield from parts(bucket, held)
                    held = []
        if held:
            yield flags(held)

    n = min(MOST_TASKS, -(-buckets // TASK_BUCKETS))
    dealt = packed.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket")
    return dealt.select("bucket", "packed").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(names, ("long", "long", "int", "int", "long", "binary"), strict=True)))


def kept_words(raw: bytes, runs: list[int] | None, k: int) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by a space) of a text whose windows in ``runs`` (low, high, low, high ...)
    go; where a window repeats within the text, one of them may be named."""
    parts = raw.split()
    if not runs:
        return len(parts), 0, b" ".join(parts)
    gone = np.zeros(len(parts) + 1, np.int64)
    data = np.frombuffer(raw, np.uint8)
    h = word_hashes(data, np.array([0, len(data)]))[0]
    spans = W.grams(h, k)
    named = np.concatenate([np.arange(a, b + 1) for a, b in zip(runs[::2], runs[1::2], strict=True)])
    at = np.flatnonzero(W.is_in(spans, np.unique(spans[named])))
    gone[at] += 1
    gone[at + k] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    kept = [parts[i] for i in np.flatnonzero(keep).tolist()]
    return len(parts), len(parts) - len(kept), b" ".join(kept)


def deduplicated(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    buckets = buckets or buckets_for(docs)
    flags = settle(super_kmers(rows, buckets, k, m), buckets, k, m)
    flags = flags.groupBy("doc_id", "row").agg(F.flatten(F.collect_list(F.array("low", "high"))).alias("runs"))
    joined = rows.join(flags, ["doc_id", "row"], "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [kept_words((t or "").encode(), s, k) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                n, gone, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
