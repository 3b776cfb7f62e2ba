"""Periodic runs of words: candidates on a harmonic grid, extended exactly on a recompression grammar."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .grammar import Grammar
from .text import BLANK, SAME, Words, chunks, words

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass
class Runs:
    """Runs of a batch of texts, by text, start and period; ``start`` counts words within the text."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def framed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as dense numbers, one number that occurs once before each text and at the end, and the texts' first places."""
    _, dense = np.unique(w.hash, return_inverse=True)
    first, docs = w.first, len(w.first) - 1
    out = np.empty(len(dense) + docs + 1, dtype=np.int64)
    out[first + np.arange(docs + 1)] = len(dense) + np.arange(docs + 1)
    out[np.arange(len(dense)) + w.doc + 1] = dense
    return out, first[:-1] + np.arange(docs) + 1


def grid_candidates(s: np.ndarray, longest: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``place, period, stretch``: places on the multiples of each period among ``repeats`` grid points that agree.

    A run of ``repeats`` periods covers as many multiples of its period, wherever it begins, so
    each has a candidate.  Of a stretch of agreeing grid points the last of each ``repeats - 1``
    pairs is kept: every run holds one.  Stretches are numbered; they may reach across texts.
    """
    places, periods, stretches, known = [], [], [], 0
    need = repeats - 1
    for p in range(1, longest // repeats + 1):
        x = s[::p]
        equal = x[1:] == x[:-1]
        if not equal.any():
            continue
        edge = np.diff(np.concatenate(([0], equal.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= need
        begin, count = begin[long], (end - begin)[long] // need
        if len(begin):
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            places.append((np.repeat(begin, count) + need * (nth + 1) - 1) * p)
            periods.append(np.full(len(nth), p))
            stretches.append(known + np.repeat(np.arange(len(begin)), count))
            known += len(begin)
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(places), np.concatenate(periods), np.concatenate(stretches)


def find(w: Words, repeats: int = 4, least: int = 6) -> Runs:
    """All maximal runs of at least ``least`` words and ``repeats`` periods in the texts of a batch."""
    lengths = np.diff(w.first)
    none = np.zeros(0, np.int64)
    if not len(lengths) or lengths.max() < max(repeats, least):
        return Runs(none, none, none, none)
    s, first = framed(w)
    place, period, stretch = grid_candidates(s, int(lengths.max()), repeats)
    # A run lies within one text, so both places of its candidate do.
    owner = np.searchsorted(first, place, side="right") - 1
    within = np.flatnonzero(owner == np.searchsorted(first, place + period, side="right") - 1)
    if not len(within):
        return Runs(none, none, none, none)
    place, period, stretch, owner = place[within], period[within], stretch[within], owner[within]
    head = np.append(True, (stretch[1:] != stretch[:-1]) | (owner[1:] != owner[:-1]))
    # Only texts with candidates need a grammar.
    wanted = np.unique(owner)
    sizes = lengths[wanted] + 1
    shift = np.cumsum(sizes) - sizes  # where each wanted text's frame begins in the shorter string
    base = first[wanted] - 1
    index = np.repeat(base - shift, sizes) + np.arange(sizes.sum())
    _, dense = np.unique(s[index], return_inverse=True)
    grammar = Grammar(np.append(dense, dense.max() + 1))
    nth = np.searchsorted(wanted, owner)
    place = place - base[nth] + shift[nth]

    def extents(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, p = place[which], period[which]
        return i - grammar.backward(i, i + p), i + p + grammar.forward(i, i + p)

    # A stretch of grid points is mostly one run: its first candidate shows how far that reaches, and
    # the candidates beyond are asked one by one.
    heads = np.flatnonzero(head)
    low, high = extents(heads)
    reach = np.repeat(high, np.diff(np.append(heads, len(place))))
    rest = np.flatnonzero(~head & (place + period >= reach))
    more_low, more_high = extents(rest)
    low, high = np.concatenate((low, more_low)), np.concatenate((high, more_high))
    period, nth = period[np.concatenate((heads, rest))], nth[np.concatenate((heads, rest))]
    good = high - low >= np.maximum(least, repeats * period)
    low, high, period, nth = low[good], high[good], period[good], nth[good]
    # Multiples of a period find the same stretch; the smallest is its period.
    order = np.lexsort((period, high, low))
    low, high, period, nth = low[order], high[order], period[order], nth[order]
    keep = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)]
    low, high, period, nth = low[keep], high[keep], period[keep], nth[keep]
    order = np.lexsort((period, low))
    low, high, period, nth = low[order], high[order], period[order], nth[order]
    return Runs(wanted[nth], low - shift[nth] - 1, high - low, period)


def kept_words(w: Words, runs: Runs) -> np.ndarray:
    """Which words no run holds beyond its first period."""
    change = np.zeros(len(w.hash) + 1, dtype=np.int64)
    begin = w.first[runs.doc] + runs.start
    np.add.at(change, begin + runs.period, 1)
    np.add.at(change, begin + runs.length, -1)
    return np.cumsum(change[:-1]) <= 0


def joined(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by single spaces."""
    data, at = w.data.copy(), np.flatnonzero(kept)
    doc = w.doc[at]
    mark = np.zeros(len(data) + 1, dtype=np.int8)
    mark[w.start[at]] += 1
    mark[w.end[at]] -= 1
    take = np.cumsum(mark[:-1], dtype=np.int8) > 0
    # Another word follows in the same text, so the byte after this one is a blank of that text.
    follow = w.end[at[:-1][doc[1:] == doc[:-1]]]
    data[follow] = 0x20
    take[follow] = True
    count = np.concatenate(([0], np.cumsum(take)))
    offsets = count[w.offsets]
    return pa.LargeStringArray.from_buffers(len(w.offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[take])).cast(pa.string())


def _rows(repeats: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column("text"), BLANK, SAME)
                runs = find(w, repeats, least)
                offsets = np.searchsorted(runs.doc, np.arange(part.num_rows + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(x) for x in (runs.start, runs.length, runs.period)], fields=list(RUN_TYPE))
                columns = [part.column("doc_id"), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(offsets), items), joined(w, kept_words(w, runs))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeats: int = 4, least: int = 6) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every document.

    ``runs`` lists ``(start, length, period)`` of all maximal stretches of words whose smallest
    period fits ``repeats`` times and that have ``least`` words, by start and period; words are
    numbered from 0.  ``collapsed`` holds the words that no run contains beyond its first period,
    joined by single spaces.

    Words are whatever stands between ASCII white space, compared by 64-bit hashes.  Null and
    empty texts have no words and no runs and collapse to an empty text.  Rows that repeat an
    id, or have none, are each worked on alone; nothing is compared across rows, so no row moves.
    A text of any length is one piece of work for one task.  Other columns are ignored; an empty
    table gives an empty one.
    """
    if repeats < 2:
        raise ValueError("a run needs two periods at least")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return rows.mapInArrow(_rows(repeats, least), T.StructType(fields))


def longest(runs: str = "runs"):
    """The longest run of a list; the first of them, then the one of smallest period, if there are several."""
    better = lambda a, b: F.struct((-b["length"]).alias("l"), b["start"].alias("s"), b["period"].alias("p")) < F.struct((-a["length"]).alias("l"), a["start"].alias("s"), a["period"].alias("p"))
    return F.reduce(runs, F.lit(None).cast(RUNS.elementType), lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))
