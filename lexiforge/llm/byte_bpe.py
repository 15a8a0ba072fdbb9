"""Byte-level BPE encoding and decoding by finite-state machines.

Merges are compiled into a transducer whose states are found as they are needed.  The encoding of a text's prefixes
obeys a local rule: the last token of a prefix is the one token that ends there and whose boundary with the last token
of the shorter prefix survives all merges.  A state is a node of the token trie (the longest suffix that may still grow
into a token) together with, for each place at which such a token could start, the last token before it and the tokens
before it that are not emitted yet.  A transition emits the tokens on which all these places agree, so the lookahead is
bounded by the longest token.  Decoding runs an incremental UTF-8 machine, whose transitions on whole tokens are found
as they are needed too.

Defined results: a null or empty text has no tokens; repeated rows are encoded alike; a decoder that is left with an
unfinished or a wrong sequence puts U+FFFD there; added columns replace those of their names; other columns pass unused.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lexiforge.llm.common import table

#: States a worker keeps, which are built again when they are full, and pieces of a generation, of which it keeps two.
#: They take some 500 and 250 bytes each.
MAX_STATES = 400_000
MAX_PIECES = 150_000
#: The same for workers beside which executors have little room left.
FEW_STATES = 100_000
FEW_PIECES = 60_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: per line a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Merges:
    """The merge tree of a vocabulary: of each longer token the two it is made of."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = dict(map(reversed, ranks.items()))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            if len(token) > 1 and len(parts := self._merge(token, rank)) == 2:
                self.halves[rank] = parts
                self.merged[parts] = rank

    def _merge(self, token: bytes, below: int) -> tuple[int, ...]:
        """The tokens that merges of a rank under ``below`` leave."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def part(self, left: int, right: int) -> bool:
        """Whether the boundary between two tokens outlives all merges of their bytes.

        Goes back in time: undoes the later of the two last merges beside the boundary, and asks each time whether the
        pair that stood there would have been merged first.  Of equal ranks the leftmost merge comes first.
        """
        limit = None
        while True:
            over = self.merged.get((left, right))
            if over is not None and (limit is None or over < limit):
                return False
            if left > right and left in self.halves:
                limit, left = left, self.halves[left][1]
            elif right in self.halves:
                limit, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                limit, left = left, self.halves[left][1]
            else:
                return True


#: Ids one after another.
Tokens = tuple[int, ...]


#: Stands for the transitions of a state from which none has been taken yet.
_NO_WAY: dict[int, tuple[int, Tokens]] = {}


class Transducer:
    """Bytes to tokens.  ``states[s]`` maps a byte to the next state and the tokens that the transition emits, and is filled
    on demand; ``rest[s]`` are the tokens still to be emitted if the piece ends there."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.merges = Merges(ranks)
        self.size = {r: len(t) for t, r in ranks.items()}
        self.max_states = max_states
        self.next: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for token, rank in ranks.items():
            if len(token) == 1 or rank in self.merges.halves:
                node = 0
                for byte in token:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        self.depth.append(self.depth[node] + 1)
                        self.token.append(-1)
                    node = self.next[node][byte]
                self.token[node] = rank
        self.fail = [0] * len(self.next)
        queue = list(self.next[0].values())
        for node in queue:
            for byte, child in self.next[node].items():
                self.fail[child] = self._go(self.fail[node], byte)
                queue.append(child)
        self.states: list[dict[int, tuple[int, Tokens]]] = []
        self._clear()

    def _go(self, node: int, byte: int) -> int:
        while byte not in self.next[node]:
            if not node:
                return 0
            node = self.fail[node]
        return self.next[node][byte]

    def _clear(self) -> None:
        self.states.clear()
        self.rest: list[Tokens] = []
        self._of: list[tuple[int, tuple[tuple[int, Tokens], ...]]] = []
        self._known: dict[tuple, int] = {}
        self._state(0, ((-1, ()),))

    def _state(self, node: int, places: tuple[tuple[int, Tokens], ...]) -> int:
        key = node, places
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.states)
            self.states.append(_NO_WAY)
            self._of.append(key)
            self.rest.append(places[-1][1])
        return state

    def step(self, state: int, byte: int) -> tuple[int, Tokens]:
        """The transition, determinised when first taken.  A state holds, for each suffix that may still grow, the longest
        first and the empty one last, the last token before it (-1: none) and the tokens before it that are not emitted."""
        node, places = self._of[state]
        depth, fail, token_of, part = self.depth, self.fail, self.token, self.merges.part
        to = n = self._go(node, byte)
        now, last, at = [], None, 0
        while n:
            while depth[node] >= depth[n]:  # the suffix that grew into this one
                node, at = fail[node], at + 1
            before = places[at]
            now.append(before)
            if last is None and (token := token_of[n]) >= 0 and (before[0] < 0 or part(before[0], token)):
                last = token, (*before[1], token)
            n = fail[n]
        if last is None:
            raise ValueError(f"byte {byte} is in no token")
        now.append(last)
        first = now[0][1]
        agreed = len(first)
        for _, tokens in now:
            while tokens[:agreed] != first[:agreed]:
                agreed -= 1
        if agreed:
            now = [(token, tokens[agreed:]) for token, tokens in now]
        out = self._state(to, tuple(now)), first[:agreed]
        if not self.states[state]:
            self.states[state] = {}
        self.states[state][byte] = out
        return out

    def _fewer(self, state: int) -> int:
        """Forgets all states but this one and those with two transitions or more, which were surely met again (these too if
        they fill half the room), and returns the new number of this one."""
        ways, of = self.states.copy(), self._of
        kept = [s for s, w in enumerate(ways) if len(w) > 1 and s]
        if len(kept) > self.max_states // 2:
            kept = []
        self._clear()
        number = {s: self._state(*of[s]) for s in (0, *kept, state)}
        for s, now in number.items():
            left = {byte: (number[to], emitted) for byte, (to, emitted) in ways[s].items() if to in number}
            if left:
                self.states[now] = left
        return number[state]

    def encode(self, data: bytes) -> Tokens:
        state, states, out = 0, self.states, []
        for byte in data:
            to = states[state].get(byte)
            if to is None:
                if len(states) > self.max_states:
                    state = self._fewer(state)
                to = self.step(state, byte)
            state, emitted = to
            if emitted:
                out += emitted
        out += self.rest[state]
        return tuple(out)


class Utf8Machine:
    """Incremental UTF-8 decoding.  The state is the sequence begun, at most three bytes; a wrong or unfinished sequence
    gives one U+FFFD, and the byte that breaks it begins anew.  ``tokens`` may give whole tokens names; the machine's
    way through them is remembered by state."""

    def __init__(self, tokens: dict[int, bytes] | None = None) -> None:
        self.tokens = tokens or {}
        self.ways: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.state = b""

    @staticmethod
    def step(state: bytes, byte: int) -> tuple[str, bytes]:
        """What a byte makes known, and the next state."""
        if not state:
            if byte < 0x80:
                return chr(byte), b""
            return ("", bytes((byte,))) if 0xC2 <= byte <= 0xF4 else ("\ufffd", b"")
        lead = state[0]
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80) if len(state) == 1 else 0x80
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF) if len(state) == 1 else 0xBF
        if not low <= byte <= high:
            text, state = Utf8Machine.step(b"", byte)
            return "\ufffd" + text, state
        more = lead >= 0xE0, lead >= 0xF0
        if len(state) < 1 + sum(more):
            return "", state + bytes((byte,))
        code = lead & (0x1F, 0x0F, 0x07)[sum(more)]
        for b in (*state[1:], byte):
            code = code << 6 | b & 0x3F
        return chr(code), b""

    def feed(self, data: bytes) -> str:
        out, state = [], self.state
        for byte in data:
            text, state = self.step(state, byte)
            out.append(text)
        self.state = state
        return "".join(out)

    def feed_tokens(self, ids: Iterable[int]) -> str:
        out, ways, state = [], self.ways, self.state
        for i in ids:
            way = ways.get(state)
            if way is None:
                way = ways[state] = {}
            found = way.get(i)
            if found is None:
                self.state = state
                found = way[i] = self.feed(self.tokens[i]), self.state
            text, state = found
            out.append(text)
        self.state = state
        return "".join(out)

    def end(self) -> str:
        rest, self.state = self.state, b""
        return "\ufffd" if rest else ""


class Codec:
    """Splits texts by ``pattern`` and encodes each piece on its own; decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> None:
        self.ranks, self.max_pieces = ranks, max_pieces
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks, max_states)
        self.bytes_of = self.transducer.merges.bytes_of
        self.utf8 = Utf8Machine(self.bytes_of)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) >= self.max_pieces:
            self.older, self.pieces = self.pieces, {}
        pieces, out = self.pieces, []
        for piece in self.split(text):
            tokens = pieces.get(piece)
            if tokens is None:
                tokens = self.encode_piece(piece)
            out += tokens
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        tokens = self.older.get(piece)
        if tokens is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            tokens = (whole,) if whole is not None else self.transducer.encode(data)
        if len(piece) < 64 and len(self.pieces) < self.max_pieces:
            self.pieces[piece] = tokens
        return tokens

    def decode(self, ids: Iterable[int]) -> str:
        return self.utf8.feed_tokens(ids) + self.utf8.end()


_CODECS: dict[tuple[int, str, bool], Codec] = {}


def codec(ranks: bytes, pattern: str, few: bool = False) -> Codec:
    """The codec of a rank file's bytes, with ``few`` states and pieces or as many as usual; a Python worker compiles it once."""
    key = hash(ranks), pattern, few
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(ranks), pattern, *((FEW_STATES, FEW_PIECES) if few else (MAX_STATES, MAX_PIECES)))
    return _CODECS[key]


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", few: bool = False) -> DataFrame:
    """``df`` with ``ids``, an array of the token ids of ``text``.  ``few`` trades time for workers of half the size."""
    return _mapped(df, ranks, pattern, text, "ids array<int>", lambda c, texts: [_id_lists([c.encode(t or "") for t in texts.to_pylist()])], few)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of the token ids in ``ids``; a null array gives an empty text."""
    return _mapped(df, ranks, pattern, ids, "decoded string", lambda c, lists: [pa.array([c.decode(x or ()) for x in lists.to_pylist()], pa.string())])


def digests(df: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256: encodes ``text`` and decodes the ids again."""

    def of(c: Codec, texts: pa.Array) -> list[pa.Array]:
        counts, ids_sha, text_sha = [], [], []
        names = list(map(str, range(max(c.bytes_of) + 1)))
        for t in texts.to_pylist():
            ids = c.encode(t or "")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return _mapped(df, ranks, pattern, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", of)


def _id_lists(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])))


def _mapped(df: DataFrame, ranks: bytes, pattern: str, column: str, added: str, of, few: bool = False) -> DataFrame:
    """``df`` with columns that ``of`` makes of ``column``; a batch is worked through a few hundred rows at a time."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern, few))
    at = df.columns.index(column)
    new = StructType.fromDDL(added).fields
    kept = [i for i, c in enumerate(df.columns) if c not in {f.name for f in new}]
    schema = StructType([*(df.schema[i] for i in kept), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in kept), *of(c, part.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)


def public_ranks() -> tuple[bytes, str]:
    """The rank file and the splitting pattern of the installed public vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, *public_ranks()).drop("text")
