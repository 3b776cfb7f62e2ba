"""Repeated passages by recompression: shared high-level symbols reveal long repeats, window hashes verify them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .skew import join_counted
from .text import BLANK, GRAM, GRAM_2, SAME, Words, chunks, inverse, mix, powers, run_hashes, words

# Four rounds make symbols of about 3 words that are decided by about 22, well within a window of 50.
ROUNDS, WIDEST = 4, 24
BLANKS = r"[\x20\x09-\x0D]+"


@dataclass
class Symbols:
    """A parse of all texts of a chunk: name, words [start, end), and words [low, high) that decide it.

    Wherever the words [low, high) occur, in any text, they are parsed with this symbol at the
    same place.  Symbols that hang on the begin or end of a text reach beyond it.
    """

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def _merge(s: Symbols, head: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
    """Join the symbols at ``head`` with their right neighbours; ``low`` and ``high`` hold for all symbols already."""
    gone = np.zeros(len(s.name), dtype=bool)
    gone[head + 1] = True
    new, end, top = s.name.copy(), s.end.copy(), high.copy()
    new[head], end[head], top[head] = name, s.end[head + 1], np.maximum(high[head], high[head + 1])
    bottom = low.copy()
    bottom[head] = np.minimum(low[head], low[head + 1])
    keep = ~gone
    return Symbols(new[keep], s.start[keep], end[keep], bottom[keep], top[keep], s.doc[keep])


def _round(s: Symbols, turn: int, first: np.ndarray) -> Symbols:
    """One round: equal neighbours become run symbols, then pairs of a left and a right symbol become one.

    Names are hashes of what they stand for, so all tasks give equal pairs and runs the same name
    and no dictionary is shuffled.  A symbol's side is a bit of its name.
    """
    for runs in (True, False):
        n = len(s.name)
        if n < 2:
            return s
        together = s.doc[1:] == s.doc[:-1]
        narrow = s.end[1:] - s.start[:-1] <= WIDEST
        # What decides a symbol that has no neighbour on a side lies beyond its text.
        edge_low, edge_high = first[s.doc] - 1, first[s.doc + 1] + 1
        left_low = np.where(np.concatenate(([False], together)), np.concatenate(([0], s.low[:-1])), edge_low)
        right_high = np.where(np.concatenate((together, [False])), np.concatenate((s.high[1:], [0])), edge_high)
        if runs:
            same = together & (s.name[1:] == s.name[:-1])
            begin = np.flatnonzero(np.concatenate(([True], ~same)))
            at = np.repeat(begin, np.diff(np.append(begin, n)))
            place = np.arange(n) - at
            # Pairs are counted from the run's begin, so all of a run hangs on what stands before it.
            low = np.minimum(s.low, left_low[at])
            head = np.flatnonzero((place[:-1] % 2 == 0) & same & narrow)
            name = mix(s.name[head] ^ np.uint64(0x517CC1B727220A95))
            s = _merge(s, head, name, low, np.maximum(s.high, right_high))
        else:
            side = (mix(s.name + np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
            head = np.flatnonzero(~side[:-1] & side[1:] & together & narrow)
            paired = np.zeros(n, dtype=bool)
            paired[head] = paired[head + 1] = True
            low = np.where(~paired & side, np.minimum(s.low, left_low), s.low)
            high = np.where(~paired & ~side, np.maximum(s.high, right_high), s.high)
            name = mix(s.name[head] * np.uint64(GRAM) + mix(s.name[head + 1]) + np.uint64(turn))
            s = _merge(s, head, name, low, high)
    return s


def parse(w: Words, rounds: int = ROUNDS) -> Symbols:
    at = np.arange(len(w.hash))
    s = Symbols(w.hash.copy(), at, at + 1, at.copy(), at + 1, w.doc)
    for turn in range(rounds):
        s = _round(s, turn, w.first)
    return s


def _span_hash(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    n = len(hashes)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, n), out=total[1:])
    return (total[high] - total[low]) * powers(inverse(base), n + 1)[low]


def windows(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, and two independent hashes, of every window of ``length`` words within a text."""
    doc = w.doc
    if len(doc) < length:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    at = np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1 :])
    return at, run_hashes(w.hash, length, GRAM)[at], run_hashes(mix(w.hash + np.uint64(GRAM)), length, GRAM_2)[at]


def anchors(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every window's first word, its anchor and its two hashes.

    The anchor is a name that any other occurrence of the window's words has as well: of the
    symbols that are decided within the window the one of smallest name, or the window's own hash
    where there is none (inside long runs, or next to the ends of a text).
    """
    at, one, two = windows(w, length)
    if not len(at):
        return at, one, one, two
    s = parse(w)
    inner = np.flatnonzero((s.low >= w.first[s.doc]) & (s.high <= w.first[s.doc + 1]) & (s.high - s.low <= length))
    anchor = mix(one ^ np.uint64(0x2545F4914F6CDD1D))
    if len(inner):
        low, high = s.low[inner], s.high[inner]
        # The name together with all words that decide it: rarely shared by chance.
        name = mix(s.name[inner] + mix(_span_hash(w.hash, low, high, GRAM_2)))
        a, b = np.searchsorted(low, at), np.searchsorted(high, at + length, side="right")
        some = b > a
        # Smallest name in a range, from tables of ranges of 1, 2, 4 ... symbols.
        tables = [name]
        for level in range(1, int((b - a).max(initial=1)).bit_length()):
            half = 1 << (level - 1)
            last = tables[-1]
            tables.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
        level = np.frexp(np.maximum(b - a, 1))[1] - 1
        best = np.empty(len(at), dtype=np.uint64)
        for k, table in enumerate(tables):
            mine = np.flatnonzero(some & (level == k))
            best[mine] = np.minimum(table[a[mine]], table[b[mine] - (1 << k)])
        anchor = np.where(some, best, anchor)
    return at, anchor, one, two


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(length: int):
    """(anchor, text) once per text and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column("text"), BLANK, SAME)
                at, anchor, _, _ = anchors(w, length)
                doc = w.doc[at] if len(at) else at
                change = np.ones(len(at), dtype=bool)
                change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                text = part.column("tkey").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([_signed(anchor[change]), pa.array(text[doc[change]].astype(np.int64))], names=["anchor", "tkey"])

    return run


def _flags(values: np.ndarray, doc: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which values occur in the list of their text."""
    lists = column if isinstance(column, pa.Array) else column.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    listed = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(n)), n).astype(np.uint64)
    salt = lambda v, d: v ^ mix(d.astype(np.uint64) + np.uint64(1))
    return np.isin(salt(values, doc), salt(listed, owner))


def _window_rows(length: int):
    """(h1, h2, doc_id) of the distinct windows whose anchor is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column("text"), BLANK, SAME)
                at, anchor, one, two = anchors(w, length)
                doc = w.doc[at] if len(at) else at
                hot = np.flatnonzero(_flags(anchor, doc, part.column("shared")))
                ids = part.column("first_id").to_numpy(zero_copy_only=False).astype(np.int64)
                _, some = np.unique(mix(one[hot] ^ mix(doc[hot].astype(np.uint64))), return_index=True)
                hot = hot[some]
                columns = [_signed(one[hot]), pa.array((two[hot] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[doc[hot]])]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id"])

    return run


def removed_words(w: Words, length: int, lists: pa.Array) -> np.ndarray:
    """Which words are covered by a window that is in its text's list."""
    at, one, _ = windows(w, length)
    change = np.zeros(len(w.hash) + 1, dtype=np.int64)
    if len(at):
        gone = at[_flags(one, w.doc[at], lists)]
        np.add.at(change, gone, 1)
        np.add.at(change, gone + length, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column("text"), BLANK, SAME)
                gone = removed_words(w, length, part.column("repeats"))
                count = np.concatenate(([0], np.cumsum(gone)))
                data, texts = w.data.tobytes(), []
                for i in range(part.num_rows):
                    mine = np.flatnonzero(~gone[w.first[i] : w.first[i + 1]]) + w.first[i]
                    texts.append(b" ".join([data[a:b] for a, b in zip(w.start[mine].tolist(), w.end[mine].tolist())]).decode())
                columns = [part.column("key"), pa.array(count[w.first[1:]] - count[w.first[:-1]]), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_removed", "kept"])

    return run


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def repeated_passages(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """``key, first_id`` of all distinct texts, and ``key, first_id, text, repeats`` of those that lose words.

    ``repeats`` are the hashes of the text's windows that also start in a document of smaller id.
    """
    rows = docs.select("doc_id", text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    tkey = F.xxhash64("key").alias("tkey")
    # Copies of a text differ in their id only, so their first document stands for all of them.
    firsts = materialize(rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id")), "firsts")

    named = rows.select(tkey, "text").mapInArrow(_anchor_rows(length), "anchor long, tkey long")
    named = materialize(named, "anchors")
    shared = named.groupBy("anchor").agg(F.min("tkey").alias("a"), F.max("tkey").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.where("a <> b").select("anchor", "n"), "shared-anchors")
    lists = join_counted(named, shared, ["anchor"]).groupBy("tkey").agg(F.collect_set("anchor").alias("shared"))
    wanted = materialize(firsts.withColumn("tkey", tkey).join(lists, "tkey").select("key", "first_id", "shared"), "wanted")

    body = rows.join(wanted, (rows["key"] == wanted["key"]) & (rows["doc_id"] == wanted["first_id"]))
    body = materialize(body.select(rows["key"], "first_id", "text", "shared"), "bodies")
    found = materialize(body.select("first_id", "text", "shared").mapInArrow(_window_rows(length), "h1 long, h2 int, doc_id long"), "windows")
    start = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
    start = materialize(start.where("a < b").select("h1", "h2", "a", "n"), "first-windows")
    later = join_counted(found, start, ["h1", "h2"]).where("doc_id > a").groupBy(F.col("doc_id").alias("first_id")).agg(F.collect_set("h1").alias("repeats"))
    return firsts, body.select("key", "first_id", "text").join(later, "first_id")


def dedup_substrings(
    docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", value: Callable[[Column], Column] = lambda kept: kept
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words, joined by single spaces) for every document.

    ``value`` is applied to the kept words where they are made, before rows move: who needs only a
    digest of them spares a shuffle of the texts.

    A word goes if a window of ``length`` words covers it whose words also start in a document of
    smaller id; windows are those of the input.  Each text is parsed by rounds of recompression.
    Windows with equal words have equal anchors, so only windows whose anchor occurs in two
    different texts are compared, by 96 bits of hashes of all their words.

    Null and empty texts have no words.  Documents with a null id keep all words and make no other
    lose words; rows that repeat an id do not remove each other's words.  Other columns are
    ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    firsts, losing = repeated_passages(rows, length)
    lost = losing.select("key", "text", "repeats").mapInArrow(_kept(length), "key binary, n_removed long, kept string")
    lost = lost.select("key", "n_removed", value(F.col("kept")).alias("kept")).dropDuplicates(["key"])
    lost = materialize(firsts.join(lost, "key", "left"), "kept")

    plain = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS), lambda x: x != "")
    base = rows.select("doc_id", text_key().alias("key"), plain.alias("w")).select("doc_id", "key", F.size("w").cast("long").alias("n_words"), value(F.array_join("w", " ")).alias("all"))
    joined = base.join(lost, "key", "left")
    copy = (F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= length)
    own = (F.col("first_id") == F.col("doc_id")) & F.col("n_removed").isNotNull()
    return joined.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(copy, value(F.lit(""))).when(own, F.col("kept")).otherwise(F.col("all")).alias("kept"),
    )


