"""Whole texts as bytes in numpy: word boundaries, word hashes and hashes of runs of words.

A batch of texts stays one byte buffer.  A word's hash is a difference of prefix sums of
``byte * B ** position`` modulo 2^64, shifted back to position 0 and mixed, so the cost is a
few passes over the bytes and no Python object is made per word.  The byte classes used here
are ASCII ones, so UTF-8 can be cut without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes worked on at once; longer texts are cut into pieces between two words.  Small pieces stay
# in the processor's cache, and leave a worker that is kept for other stages small.
PIECE = 1 << 18
# Bytes in which the end of a word that a cut would part is looked for at once.
AHEAD = 1 << 10
CHUNK = 1 << 20
BASE, BASE_2, GRAM, GRAM_2 = 0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MASK = (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}


def byte_class(pattern: str) -> np.ndarray:
    """Which of the 256 bytes belong to the words: ``blank`` (not ASCII white space) or ``alnum`` (0-9, a-z, non-ASCII)."""
    table = np.zeros(256, dtype=bool)
    if pattern == "blank":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    else:
        raise ValueError(f"unknown word class {pattern}")
    return table


BLANK, ALNUM = byte_class("blank"), byte_class("alnum")
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i in 0..n-1."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.empty(max(n, PIECE + 4096), dtype=np.uint64)
        known[0], done = 1, 1
        while done < len(known):
            more = min(done, len(known) - done)
            known[done : done + more] = known[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _POWERS[base] = known
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@dataclass
class Words:
    """The words of a batch of texts, in order.

    ``start`` and ``end`` are byte positions in ``data``; ``first[i]`` to ``first[i + 1]`` are
    the words of text i; ``doc`` is the text of each word.
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text and at least one row."""
    _, offsets = column_bytes(batch.column(text))
    row = 0
    while row < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        upto = min(max(upto, row + 1), batch.num_rows)
        yield batch.slice(row, upto - row)
        row = upto


def words(column: pa.Array, word: np.ndarray = BLANK, fold: np.ndarray = SAME) -> Words:
    """Cut every text into maximal runs of ``word`` bytes, each hashed after ``fold``."""
    data, offsets = column_bytes(column)
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    cuts = np.unique(offsets)
    folded, belongs = fold.tobytes(), word[fold].tobytes()
    while at < n:
        upto = min(at + PIECE, n)
        while upto < n and word[fold[data[upto]]] and word[fold[data[upto - 1]]]:
            more = np.flatnonzero(~word[fold[data[upto : upto + AHEAD]]])
            upto = upto + int(more[0]) if len(more) else min(upto + AHEAD, n)
        raw = data[at:upto].tobytes()
        piece, inside = np.frombuffer(raw.translate(folded), np.uint8), np.frombuffer(raw.translate(belongs), np.bool_)
        edge = np.zeros(len(piece) + 1, dtype=bool)
        edge[cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, upto, side="right")] - at] = True
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        begin = np.flatnonzero(inside & (~before | edge[:-1]))
        stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
        total = np.empty(len(piece) + 1, dtype=np.uint64)
        total[0] = 0
        value = piece.astype(np.uint64)
        value += np.uint64(1)
        value *= powers(BASE, len(piece))
        np.cumsum(value, out=total[1:])
        value = (total.take(stop) - total.take(begin)) * powers(inverse(BASE), len(piece) + 1).take(begin)
        hashes.append(mix(value + (stop - begin).astype(np.uint64) * np.uint64(BASE_2)))
        starts.append(begin + at)
        ends.append(stop + at)
        at = upto
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(data, offsets, start, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(start, offsets))


def run_hashes(hashes: np.ndarray, length: int, base: int = GRAM) -> np.ndarray:
    """A hash for each run of ``length`` neighbouring hashes (runs across texts included)."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    if length <= 8:
        out = np.zeros(n - length + 1, dtype=np.uint64)
        for i in range(length):
            out = out * np.uint64(base) + hashes[i : n - length + 1 + i]
        return mix(out)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, n), out=total[1:])
    return mix((total[length:] - total[:-length]) * powers(inverse(base), n - length + 1))


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def covered(n: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0
