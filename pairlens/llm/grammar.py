"""A run-length grammar by recompression, and exact extensions of equal substrings on it.

The string is rewritten in turns: block compression gives every maximal block of one symbol
a symbol of its own, pair compression then joins every left symbol that stands before a right
one.  Names are given by what they stand for, so equal symbols spell equal substrings, and the
turns go on until no symbol occurs twice.  How far two places agree (a longest common
extension) is read off the levels: climb while both places begin a symbol of the next level,
skip equal symbols on the way, and walk down again where they differ.  A query touches a
constant number of symbols a level, and all queries take each step together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .text import mix

# Queries that walk the levels together; more are answered in turns, which bounds memory.
QUERIES_AT_ONCE = 1 << 16


@dataclass
class Level:
    """The string at one turn.  ``parent`` is a symbol's place in the next level, ``first`` where that one's children begin."""

    name: np.ndarray
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _up(level: Level, starts: np.ndarray, names: np.ndarray) -> Level:
    """Close a level whose symbols are grouped at ``starts``; the next one holds ``names``."""
    begin = np.zeros(len(level.name), dtype=np.int64)
    begin[starts] = 1
    level.parent = np.cumsum(begin) - 1
    level.first = np.append(starts, len(level.name))
    return Level(names)


class Grammar:
    """Levels over ``symbols`` (numbers from 0, dense).  The first and the last symbol must occur once only."""

    def __init__(self, symbols: np.ndarray):
        self.levels = [Level(symbols.astype(np.int64))]
        self.names = int(symbols.max(initial=-1)) + 1
        turn = 0
        while np.bincount(self.levels[-1].name, minlength=1).max() > 1:
            self._blocks()
            self._pairs(turn)
            turn += 1

    def _blocks(self) -> None:
        level = self.levels[-1]
        name = level.name
        starts = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        size = np.diff(np.append(starts, len(name)))
        names, long = name[starts], np.flatnonzero(size > 1)
        if len(long):
            kinds, which = np.unique(names[long] * (len(name) + 1) + size[long], return_inverse=True)
            names = names.copy()
            names[long] = self.names + which
            self.names += len(kinds)
        self.levels.append(_up(level, starts, names))

    def _pairs(self, turn: int) -> None:
        level = self.levels[-1]
        name = level.name
        right = (mix(name.astype(np.uint64) * np.uint64(2) + np.uint64(1) + (np.uint64(turn) << np.uint64(40))) & np.uint64(1)).astype(bool)
        head = np.flatnonzero(~right[:-1] & right[1:])
        alone = np.ones(len(name), dtype=bool)
        alone[head + 1] = False
        starts, names = np.flatnonzero(alone), name
        if len(head):
            kinds, which = np.unique(name[head] * self.names + name[head + 1], return_inverse=True)
            names = name.copy()
            names[head] = self.names + which
            self.names += len(kinds)
        self.levels.append(_up(level, starts, names[starts]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different places, the number of equal symbols from them on."""
        return self._extend(i, j, True)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same, of the symbols before them."""
        return self._extend(i, j, False)

    def _extend(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        out = np.empty(len(i), dtype=np.int64)
        for at in range(0, len(i), QUERIES_AT_ONCE):
            part = slice(at, at + QUERIES_AT_ONCE)
            out[part] = self._walk(i[part], j[part], ahead)
        return out

    def _step(self, level: Level, a: np.ndarray, b: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
        """How many children each of two places has left in its parent, itself included."""
        if ahead:
            return level.first[level.parent[a] + 1] - a, level.first[level.parent[b] + 1] - b
        return a - level.first[level.parent[a]] + 1, b - level.first[level.parent[b]] + 1

    def _walk(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        # The places are those of the next symbol to compare.
        sign = 1 if ahead else -1
        a, b = (i.copy(), j.copy()) if ahead else (i - 1, j - 1)
        top = np.full(len(a), len(self.levels) - 1)  # the level where the pair was found to differ
        climbing = np.arange(len(a))
        for k, level in enumerate(self.levels[:-1]):
            for _ in range(4):
                if not len(climbing):
                    break
                x, y = a[climbing], b[climbing]
                px, py = level.parent[x], level.parent[y]
                if ahead:
                    edge = (level.first[px] == x) & (level.first[py] == y)
                else:
                    edge = (level.first[px + 1] - 1 == x) & (level.first[py + 1] - 1 == y)
                inner = climbing[~edge]
                if not len(inner):
                    break
                x, y = a[inner], b[inner]
                same = level.name[x] == level.name[y]
                top[inner[~same]] = k
                moved = inner[same]
                self._advance(level, a, b, moved, k, sign, ahead)
                climbing = climbing[top[climbing] > k]
            a[climbing], b[climbing] = level.parent[a[climbing]], level.parent[b[climbing]]
        for k in range(len(self.levels) - 2, -1, -1):
            level = self.levels[k]
            came = np.flatnonzero(top > k)
            if len(came):
                x, y = a[came], b[came]
                a[came] = level.first[x] if ahead else level.first[x + 1] - 1
                b[came] = level.first[y] if ahead else level.first[y + 1] - 1
            here = np.flatnonzero(top >= k)
            while len(here):
                here = here[level.name[a[here]] == level.name[b[here]]]
                self._advance(level, a, b, here, k, sign, ahead)
        return a - i if ahead else i - 1 - a

    def _advance(self, level: Level, a: np.ndarray, b: np.ndarray, which: np.ndarray, k: int, sign: int, ahead: bool) -> None:
        """Skip equal symbols: one before a pair step, all that two blocks have in common before a block step."""
        if not len(which):
            return
        step = 1
        if k % 2 == 0:
            left, right = self._step(level, a[which], b[which], ahead)
            step = np.minimum(left, right)
        a[which] += sign * step
        b[which] += sign * step
