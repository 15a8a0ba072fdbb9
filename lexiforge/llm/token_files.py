"""Token-id files compressed by grammars.

Documents are encoded in ascending doc_id order and cut into shards of consecutive ids.  In each shard frequent pairs of
ids are replaced by nonterminals again and again (Re-Pair) until no pair is frequent any more.  A round counts pairs
and replaces each place whose pair is more frequent than those that overlap it; the next round need only look at what
was frequent before and at the neighbours of new nonterminals.  A shard stores its rules, the length of each rule's
expansion, and the remaining sequence; with the lengths any range of ids is decoded without the rest.

Shards are rows of a Parquet table, so that writing is atomic for each task: ``part`` and ``shard`` give their order.

Defined results: a null or empty text is the end id alone; rows with a null doc_id come first; rows that repeat a doc_id
follow one another in the order of a hash of their text; other columns pass unused.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm import words as W
from lexiforge.llm.common import shared_path, small_or_shuffled, table, text_bytes

END = 1
SHARD_IDS = 1 << 20
#: A pair is frequent from this many places on: a rule takes three numbers, each place saves one.
LEAST = 6
PART_BYTES = 32 << 20
#: Pieces a worker remembers the ids of.
MAX_PIECES = 2_000_000
#: Plain pieces that the tokenizer is asked for in one text.
TOGETHER = 256
#: Ids that reading back expands at a time, and parts whose starts are summed together.
READ_IDS = 1 << 16
PARTS = 1024


@dataclass
class Grammar:
    """Symbols below ``base`` are ids; symbol ``base + i`` stands for the two symbols ``rules[i]``."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray  # of the expansion of each rule
    sequence: np.ndarray

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.base
        out[big] = self.lengths[symbols[big] - self.base]
        return out

    @cached_property
    def ends(self) -> np.ndarray:
        """Where the expansion of each symbol of the sequence ends."""
        return np.cumsum(self._length(self.sequence))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self._length(symbols)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        while len(symbols):
            big = symbols >= self.base
            out[at[~big]] = symbols[~big]
            left, right = self.rules[symbols[big] - self.base].T
            symbols, at = np.concatenate((left, right)), np.concatenate((at[big], at[big] + self._length(left)))
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids [start, stop); only the symbols that cover them are expanded."""
        ends = self.ends
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.sequence[a:b])[skip : skip + stop - start]


_SLOT_BITS = 20
#: A bijection of 32-bit numbers, which orders pairs of one frequency without regard to their places.
_SHUFFLE = 0x9E3779B1


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys by their first places, and for each key its number among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which of the keys occur ``least`` times or more, the distinct ones, the number of each that does, and counts."""
    at = None
    if len(key) >> (_SLOT_BITS - 4):  # enough for the slots to be worth their while
        slot = ((key.view(W.U64) * W.U64(0x9E3779B97F4A7C15)) >> W.U64(64 - _SLOT_BITS)).view(np.int64)
        at = np.flatnonzero(np.bincount(slot, minlength=1 << _SLOT_BITS)[slot] >= least)
        key = key[at]
    known, which = _numbered(key)
    count = np.bincount(which, minlength=len(known))
    often = np.flatnonzero((count >= least)[which])
    return often if at is None else at[often], known, which[often], count


def _chosen(active: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places have a pair of higher rank than those that overlap it; equal ranks side by side are a run of one
    symbol, of whose places every other one is chosen."""
    beside, step = np.diff(active) == 1, np.diff(rank)
    take = np.ones(len(active), bool)
    take[:-1] &= ~(beside & (step > 0))
    take[1:] &= ~(beside & (step < 0))
    on = np.flatnonzero(beside & (step == 0)) + 1  # places that go on with a run
    if len(on):
        head = np.flatnonzero(np.diff(on, prepend=-1) != 1)
        within = on - np.repeat(on[head] - 1, np.diff(head, append=len(on)))
        take[on[within % 2 == 1]] = False
    return take


def compress(ids: np.ndarray, least: int = LEAST) -> Grammar:
    base = int(ids.max()) + 1 if len(ids) else 0
    sequence, rules, lengths = ids.astype(np.int32), [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64)
    active = np.arange(len(sequence) - 1)  # every place of every pair that may be frequent
    while len(active):
        hit, known, which, count = _frequent((sequence[active].astype(np.int64) << 32) | sequence[active + 1], least)
        active = active[hit]
        if not len(active):
            break
        rank = (count << 32) | ((np.arange(len(known)) * _SHUFFLE) & 0xFFFFFFFF)
        take = _chosen(active, rank[which])
        tally = np.bincount(which[take], minlength=len(known))
        used = np.flatnonzero(tally >= min(2, least))
        if not len(used):
            break
        used = used[np.argsort(known[used])]
        symbol = np.full(len(known), -1, np.int32)
        symbol[used] = base + len(lengths) + np.arange(len(used))
        made = np.stack((known[used] >> 32, known[used] & 0xFFFFFFFF), axis=1)
        rules.append(made)
        size = np.ones(made.shape, np.int64)
        size[made >= base] = lengths[made[made >= base] - base]
        lengths = np.append(lengths, size.sum(axis=1))
        to = symbol[which]
        take &= to >= 0
        at = active[take]
        sequence[at] = to[take]
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        look = np.zeros(len(sequence), bool)
        look[active] = True
        look, sequence = look[keep], sequence[keep]
        at -= np.arange(len(at))  # one symbol less for each place before
        look[at] = True
        look[at[at > 0] - 1] = True
        look[len(sequence) - 1 :] = False
        active = np.flatnonzero(look)
    return Grammar(base, np.concatenate(rules), lengths, sequence.astype(np.int64))


SHARD = "part int, shard int, n_ids long, base int, docs binary, counts binary, rules binary, lengths binary, sequence binary"


def _squeezed(x: np.ndarray, kind) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, kind).tobytes())


def _loosened(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def shard_row(part: int, shard: int, docs: list[int | None], counts: list[int], ids: np.ndarray) -> dict:
    g = compress(ids)
    known = np.array([d is not None for d in docs])
    numbers = np.stack((known.astype(np.int64), np.array([d or 0 for d in docs], np.int64)))
    return {
        "part": part, "shard": shard, "n_ids": len(ids), "base": g.base, "docs": _squeezed(numbers, "<i8"), "counts": _squeezed(counts, "<i8"),
        "rules": _squeezed(g.rules, "<i4"), "lengths": _squeezed(g.lengths, "<i4"), "sequence": _squeezed(g.sequence, "<i4"),
    }


def read_shard(row: dict) -> tuple[list[int | None], np.ndarray, Grammar]:
    known, docs = _loosened(row["docs"], "<i8").reshape(2, -1)
    g = Grammar(row["base"], _loosened(row["rules"], "<i4").reshape(-1, 2).astype(np.int64), _loosened(row["lengths"], "<i4").astype(np.int64), _loosened(row["sequence"], "<i4").astype(np.int64))
    return [int(d) if k else None for k, d in zip(known, docs, strict=True)], _loosened(row["counts"], "<i8"), g


#: Bytes by kind: white space, letters, digits, others, and those whose word is left to the tokenizer whole.
_KIND = np.full(256, 3, np.uint8)
_KIND[W.SPACE] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x80, 0x100), 0x27, 0x3C, *range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = 4
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF, and how far small ones lie behind.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SMALL_LATIN = np.zeros(256, np.uint8)
_SMALL_LATIN[0x80:0x9F] = 32
_SMALL_LATIN[0x97] = 0


def _mapped(data: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.frombuffer(bytearray(data).translate(to.tobytes()), np.uint8)


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and where the letters from U+00C0 to U+00FF begin."""
    kind = _mapped(data, _KIND)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = 1
    return kind, lead


def pieces(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    """What the tokenizer encodes each on its own: of a word of letters up to U+00FF, digits and ASCII marks its runs of
    letters, in small letters, its single digits and its runs of marks; any other word is a piece, unchanged."""
    w = W.scan(data, offsets, W.SPACE)
    if not len(w.begin):
        return w
    kind, lead = _kinds(data)
    small = _mapped(data, _LOWER)
    small[lead + 1] = data[lead + 1] + _SMALL_LATIN[data[lead + 1]]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0) & (kind[:-1] > 0)
    if (odd := np.flatnonzero(kind == 4)).size:
        whole = np.unique(np.searchsorted(w.begin, odd, side="right") - 1)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[w.begin[whole]] += 1
        inside[w.end[whole]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        cut[1:-1] &= ~(inside[1:] & inside[:-1])
        small = np.where(inside, data, small)
    begins, ends = cut.copy(), cut
    begins[w.begin] = ends[w.end] = True
    begin = np.flatnonzero(begins)
    return W.Words(small, begin, np.flatnonzero(ends), np.searchsorted(begin, offsets), offsets)


class _Grown:
    """An array that is appended to."""

    def __init__(self, kind) -> None:
        self.data, self.size = np.zeros(1 << 16, kind), 0

    def append(self, x: np.ndarray) -> None:
        if self.size + len(x) > len(self.data):
            self.data = np.concatenate((self.data[: self.size], np.zeros(max(len(x), self.size), self.data.dtype)))
        self.data[self.size : self.size + len(x)] = x
        self.size += len(x)


class PieceEncoder:
    """A tokenizer that drops white space, asked piece by piece: the tokenizer sees each distinct piece once for as long as
    it is remembered.  Plain pieces (letters, a digit or marks, which ``pieces`` has cut and put in small letters already) go
    to its model many at a time, parted at blanks only; each ends at a token that ends a word.  Pieces are found by one
    64-bit hash and recognised by another."""

    def __init__(self, path: str, limit: int = MAX_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.parted = Tokenizer(self.tokenizer.model)
        self.parted.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        known = self.tokenizer.get_vocab()
        self.last = np.zeros(max(known.values()) + 1, bool)  # the tokens that end a word
        self.last[[i for token, i in known.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted hashes and the pieces' numbers; few large, then small ones
        self.ids, self.ends, self.second = _Grown(np.int32), _Grown(np.int64), _Grown(W.U64)
        self.ends.append(np.zeros(1, np.int64))

    def _encoded(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def _ask(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        text, at = W.gather(np.append(data, np.uint8(0x20)), begin, end + 1)
        text[at[1:] - 1] = 0x20  # a blank behind each piece
        plain = ~np.logical_or.reduceat(_kinds(text)[0] == 4, at[:-1])
        raw = text.tobytes()
        single = lambda pick: [raw[a : b - 1].decode() for a, b in zip(at[:-1][pick].tolist(), at[1:][pick].tolist(), strict=True)]
        together, cut = W.gather(text, at[:-1][plain], at[1:][plain])
        cut, together = [*cut[:-1:TOGETHER].tolist(), len(together)], together.tobytes()
        ids, _ = self._encoded(self.parted, [together[a:b].decode() for a, b in pairwise(cut)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != plain.sum() or len(ids) != (ends[-1] if len(ends) else 0):  # a tokenizer that does not mark ends of words
            return self._encoded(self.tokenizer, single(slice(None)))
        others, other_size = self._encoded(self.tokenizer, single(~plain))
        size = np.empty(len(begin), np.int64)
        size[plain], size[~plain] = np.diff(ends, prepend=0), other_size
        to = np.empty(len(begin), np.int64)
        to[plain], to[~plain] = ends, len(ids) + np.cumsum(other_size)
        return W.gather(np.concatenate((ids, others)), to - size, to)[0], size

    def _learn(self, h: np.ndarray, second: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        numbers = np.arange(self.ends.size - 1, self.ends.size - 1 + len(h))
        self.ends.append(self.ids.size + np.cumsum(size))
        self.ids.append(ids)
        self.second.append(second)
        level = h, numbers
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            both = np.concatenate((self.levels[-1][0], level[0]))
            order = np.argsort(both, kind="stable")
            level = both[order], np.concatenate((self.levels.pop()[1], level[1]))[order]
        self.levels.append(level)
        return numbers

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the pieces with these sorted hashes, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        for known, numbers in self.levels:
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            out[hit] = numbers[at[hit]]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        w = pieces(data, offsets)
        distinct, which = _numbered(w.hashes())
        order = np.argsort(distinct)
        distinct = distinct[order]
        found = self._numbers(distinct)
        new = found < 0
        if self.ends.size + new.sum() > self.limit:
            self._forget()
            new[:] = True
        second = w.second_hashes()
        if new.any():
            at = np.empty(len(order), np.int64)
            at[which] = np.arange(len(which))
            at = at[order[new]]  # a place of each
            found[new] = self._learn(distinct[new], second[at], *self._ask(w.data, w.begin[at], w.end[at]))
        number = np.empty(len(order), np.int64)
        number[order] = found
        number = number[which]
        begin, end, flat = self.ends.data[number], self.ends.data[number + 1], self.ids.data[: self.ids.size]
        if (other := np.flatnonzero(self.second.data[number] != second)).size:  # two pieces with one hash
            found, size = self._ask(w.data, w.begin[other], w.end[other])
            end[other] = len(flat) + np.cumsum(size)
            begin[other] = end[other] - size
            flat = np.concatenate((flat, found))
        ids, ends = W.gather(flat, begin, end)
        return ids, np.diff(ends[w.first])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def shards(docs: DataFrame, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The documents (doc_id, text) as shards, in the order of ``part`` and ``shard``."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // PART_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    rows = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        names, sizes, held, total = [], [], [], 0

        def cut() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard_row(part, shard, names, sizes, np.concatenate(held))], schema)

        for batch in batches:
            for a, b, data, offsets in W.chunks(batch.column(2)):
                ids, counts = encode(data, offsets)
                ids = np.insert(ids, np.cumsum(counts), end)
                names += batch.column(0).slice(a, b - a).to_pylist()
                sizes += (counts + 1).tolist()
                held.append(ids)
                total += len(ids)
                if total >= shard_ids:
                    yield cut()
                    shard, names, sizes, held, total = shard + 1, [], [], [], 0
        if total:
            yield cut()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("base", pa.int32()), *[(c, pa.binary()) for c in ("docs", "counts", "rules", "lengths", "sequence")]])
    return rows.select("doc_id", "row", "text").mapInArrow(run, SHARD)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    shards(docs, tokenizer, end).write.parquet(path)


def _starts(totals: DataFrame) -> DataFrame:
    """(part, shard, first): the ids before each shard of ``totals`` (part, shard, n_ids).  Sums run within parts, within
    PARTS parts, and over these groups, of which there is one for some 32 GB of text."""
    before = lambda w: F.sum("n_ids").over(w) - F.col("n_ids")
    group = F.floor(F.col("part") / PARTS).alias("group")
    parts = totals.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", "n_ids", group)
    groups = parts.groupBy("group").agg(F.sum("n_ids").alias("n_ids"))
    groups = groups.select("group", before(Window.orderBy("group")).alias("_group"))
    parts = parts.select("part", "group", before(Window.partitionBy("group").orderBy("part")).alias("_part"))
    shards = totals.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("_shard"))
    return shards.join(parts, "part").join(groups, "group").select("part", "shard", (F.col("_shard") + F.col("_part") + F.col("_group")).alias("first"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at ``path``."""
    files = spark.read.schema(SHARD).parquet(path)
    starts = _starts(files.select("part", "shard", "n_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs, counts, grammar = read_shard(row)
                ends, crc, at = np.cumsum(counts), [], 0
                while at < len(docs):  # by the expansion lengths, so many documents at a time as hold about READ_IDS
                    low = int(ends[at] - counts[at])
                    to = max(at + 1, int(np.searchsorted(ends, low + READ_IDS, side="right")))
                    view = memoryview(grammar.ids(low, int(ends[to - 1])).astype("<u4").tobytes())
                    crc += [zlib.crc32(view[4 * (b - n - low) : 4 * (b - low)]) for b, n in zip(ends[at:to].tolist(), counts[at:to].tolist(), strict=True)]
                    at = to
                columns = [pa.array([row["part"]] * len(docs), pa.int32()), pa.array([row["shard"]] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    placed = found.join(small_or_shuffled(starts, files.count()), ["part", "shard"])
    return placed.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizer())
    return read(spark, path)
