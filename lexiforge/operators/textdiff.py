"""Edits between two texts by longest common blocks, found with a suffix automaton of one of them.

The longest block that two ranges of characters share is kept (of equally long ones that which starts first in the old
text, then in the new one), then the ranges before and after it are worked on in the same way.  A range costs time and
space in proportion to its length, however often its characters occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Automaton:
    """The substrings of a text: states with transitions, a suffix link, the length of their longest string, and where
    its first occurrence ends."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text):
            state = self._add(dict(), self.length[last] + 1, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p < 0:
                self.link[state] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[state] = q
                else:
                    copy = self._add(dict(self.next[q]), self.length[p] + 1, self.end[q])
                    self.link[copy] = self.link[q]
                    self.link[q] = self.link[state] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
            last = state

    def _add(self, moves: dict[str, int], length: int, end: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.end.append(end)
        self.link.append(0)
        return len(self.next) - 1

    def longest(self, text: str) -> tuple[int, int, int]:
        """(start in ``text``, start in the automaton's text, length) of the longest common block; length 0 for none."""
        state = size = 0
        best = 0, 0, 0
        for at, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            if size > best[2]:
                best = at - size + 1, self.end[state] - size + 1, size
        return best


def blocks(old: str, new: str) -> list[tuple[int, int, int]]:
    """The common blocks (start in old, start in new, length) in order; neighbouring ones are one."""
    todo, found = [(0, len(old), 0, len(new))], []
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if old[a:b] == new[c:d]:
            found.append((a, c, b - a))
            continue
        i, j, n = Automaton(new[c:d]).longest(old[a:b])
        if n:
            found.append((a + i, c + j, n))
            todo += [(a, a + i, c, c + j), (a + i + n, b, c + j + n, d)]
    out: list[tuple[int, int, int]] = []
    for a, c, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == a and out[-1][1] + out[-1][2] == c:
            out[-1] = out[-1][0], out[-1][1], out[-1][2] + n
        else:
            out.append((a, c, n))
    return out


def edits(old: str, new: str) -> list[tuple[str, int, str, str]]:
    """(kind, position in old, what was there, what is there now) for what is not common, in order."""
    out, a, c = [], 0, 0
    for i, j, n in [*blocks(old, new), (len(old), len(new), 0)]:
        if a < i or c < j:
            out.append(("replace" if a < i and c < j else "delete" if a < i else "insert", a, old[a:i], new[c:j]))
        a, c = i + n, j + n
    return out


KIND = "array<struct<kind:string,position:int,original:string,modified:string>>"


def with_edits(pairs: DataFrame, old: str, new: str, name: str = "edits") -> DataFrame:
    """``pairs`` with the edits that turn text ``old`` into ``new``; null if either is null.  Positions are code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("position", pa.int32()), ("original", pa.string()), ("modified", pa.string())]))
    columns = [c for c in pairs.columns if c != name]
    own = "_" * (1 + max(map(len, columns), default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.num_columns - n).to_pylist() for n in (2, 1))
            found = [None if x is None or y is None else [dict(zip(("kind", "position", "original", "modified"), e, strict=True)) for e in edits(x, y)] for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, kind)], names=[*columns, name])

    shape = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in columns)
    return pairs.select(*[F.col(f"`{c}`") for c in columns], F.col(old).alias(f"{own}a"), F.col(new).alias(f"{own}b")).mapInArrow(run, f"{shape}, `{name}` {KIND}")
