"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .text import ALNUM, LOWER, Words, chunks, words

# Words of the items that one automaton holds; more items make more automata, run one after the other.
SHARD_WORDS = 200_000
SPANS = "array<struct<start:int,end:int>>"


class Automaton:
    """Suffix automaton of several word sequences, and the windows that count as hits in it.

    ``window`` neighbouring words of an item are a window; an item with fewer words is one window
    as a whole.  Words are numbered by their place in ``vocabulary``.
    """

    def __init__(self, items: Sequence[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        spelled = sorted({w for _, ws in items for w in ws})
        hashed = words(pa.array([w.decode() for w in spelled], pa.string()), ALNUM, LOWER).hash
        order = np.argsort(hashed, kind="stable")
        self.vocabulary, self.spelling = hashed[order], [spelled[i] for i in order]
        number = {w: i for i, w in enumerate(self.spelling)}
        self.next: dict[int, int] = {}
        self.length, self.link, self.out = [0], [-1], [[]]
        coded = [(item, [number[w] for w in ws]) for item, ws in items if ws]
        pairs: set[int] = set()
        for _, tokens in coded:
            self._add(tokens)
            pairs.update(a * len(spelled) + b for a, b in zip(tokens, tokens[1:]))
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.shortest = min((min(len(t), window) for _, t in coded), default=window)
        self._mark(coded)
        seen = np.zeros(1 << 20, dtype=bool)
        seen[self.vocabulary & np.uint64(len(seen) - 1)] = True
        self.seen = seen
        del self.out

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.length) - 1

    def _clone(self, p: int, token: int, q: int) -> int:
        """Split off the shorter words of state q that end in ``token`` after p."""
        new = self._state(self.length[p] + 1, self.link[q])
        for t in self.out[q]:
            self.next[new << 32 | t] = self.next[q << 32 | t]
        self.out[new] = list(self.out[q])
        self.link[q] = new
        while p >= 0 and self.next.get(p << 32 | token) == q:
            self.next[p << 32 | token] = new
            p = self.link[p]
        return new

    def _add(self, tokens: list[int]) -> None:
        last = 0
        for token in tokens:
            q = self.next.get(last << 32 | token)
            if q is not None:  # an earlier item had this prefix
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
                continue
            current = self._state(self.length[last] + 1, 0)
            p = last
            while p >= 0 and p << 32 | token not in self.next:
                self.next[p << 32 | token] = current
                self.out[p].append(token)
                p = self.link[p]
            if p >= 0:
                q = self.next[p << 32 | token]
                self.link[current] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
            last = current

    def _mark(self, coded: list[tuple[int | None, list[int]]]) -> None:
        """File items under the states of their windows, and per state the nearest such state among its suffixes."""
        n = len(self.length)
        self.whole: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, int | None]]] = {}

        def suffix(state: int, size: int) -> int:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            return state

        for item, tokens in coded:
            state = 0
            for j, token in enumerate(tokens):
                state = self.next[state << 32 | token]
                if j + 1 >= self.window:
                    self.whole.setdefault(suffix(state, self.window), set()).add(item)
            if len(tokens) < self.window:
                self.short.setdefault(suffix(state, len(tokens)), []).append((len(tokens), item))
        self.window_state, self.short_state = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= self.window:
                self.window_state[v] = v if self.length[up] < self.window else self.window_state[up]
            self.short_state[v] = v if v in self.short else self.short_state[up]

    def stream(self, tokens: list[int]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit windows as (start, end), the items they belong to, and the longest match."""
        following, length, link = self.next, self.length, self.link
        spans, items, v, matched, longest = [], set(), 0, 0, 0
        for j, token in enumerate(tokens):
            to = following.get(v << 32 | token)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = following.get(v << 32 | token)
            if to is None:
                matched = 0
                continue
            v, matched = to, matched + 1
            longest = max(longest, matched)
            if matched >= self.window:
                state = self.window_state[v]
                spans.append((j + 1 - self.window, j + 1))
                items |= self.whole[state]
            u = self.short_state[v]
            while u:
                for size, item in self.short[u]:
                    if size <= matched:
                        spans.append((j + 1 - size, j + 1))
                        items.add(item)
                u = self.short_state[link[u]]
        return spans, items, longest

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word hash, -1 for words that no item has."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[hashes & np.uint64(len(self.seen) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at, -1)
        return out

    def segments(self, w: Words) -> Iterator[tuple[int, list[int]]]:
        """Ranges of words, within a text, that could hold a window: runs whose every neighbouring pair occurs in an item."""
        if not len(self.vocabulary):
            return
        known = self.numbers(w.hash)
        within = np.zeros(max(len(known) - 1, 0), dtype=bool)
        left = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0))
        if len(left) and len(self.pairs):
            code = known[left] * len(self.vocabulary) + known[left + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            within[left] = self.pairs[at] == code
        breaks = w.first[1:-1]
        breaks = breaks[(breaks > 0) & (breaks < len(known))]
        within[breaks - 1] = False
        begin = np.flatnonzero((known >= 0) & ~np.concatenate(([False], within)))
        end = np.flatnonzero((known >= 0) & ~np.concatenate((within, [False]))) + 1
        keep = end - begin >= self.shortest
        for a, b in zip(begin[keep].tolist(), end[keep].tolist()):
            # Equal hashes are only a hint: the words themselves decide.
            tokens = known[a:b].tolist()
            for i in range(a, b):
                if LOWER[w.data[w.start[i] : w.end[i]]].tobytes() != self.spelling[tokens[i - a]]:
                    tokens[i - a] = -1
            yield a, tokens


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan(shared, text: str):
    """Add the hits of one automaton to the rows' ``hits``, ``found`` and ``longest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = pickle.loads(zlib.decompress(shared.value))
        for batch in batches:
            for part in chunks(batch, text):
                w = words(part.column(text), ALNUM, LOWER)
                hits = [[(s["start"], s["end"]) for s in row] for row in part.column("hits").to_pylist()]
                found = [set(row) for row in part.column("found").to_pylist()]
                longest = part.column("longest").to_pylist()
                for at, tokens in automaton.segments(w):
                    spans, items, best = automaton.stream(tokens)
                    doc = int(np.searchsorted(w.first, at, side="right")) - 1
                    base = at - int(w.first[doc])
                    hits[doc] += [(a + base, b + base) for a, b in spans]
                    found[doc] |= items
                    longest[doc] = max(longest[doc], best)
                spans = pa.array([[{"start": a, "end": b} for a, b in union(row)] for row in hits], part.column("hits").type)
                items = pa.array([sorted(i for i in row if i is not None) for row in found], part.column("found").type)
                new = {"hits": spans, "found": items, "longest": pa.array(longest, pa.int32()), "n_words": pa.array(np.diff(w.first).astype(np.int64))}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names], names=part.schema.names)

    return run


def automata(items: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> DataFrame:
    """``shard, data``: the items dealt into shards of about ``shard_words`` words, each built into an automaton by a task of its own.

    Ids keep their type if they are whole numbers, other ones become texts.
    """
    folded = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(item_id).cast(item_type(items, item_id)).alias("item"), F.regexp_extract_all(folded, F.lit(WORD), 0).alias("w"))
    rows = rows.where(F.size("w") > 0)
    total = rows.agg(F.sum(F.size("w"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item", "w"), F.lit(shards)).cast("int"))

    def build(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        held = [(i, [w.encode() for w in ws]) for i, ws in zip(table.column("item").to_pylist(), table.column("w").to_pylist())]
        # In one order whatever way the rows came.
        held.sort(key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))
        data = zlib.compress(pickle.dumps(Automaton(held, window)), 1)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(build, "shard int, data binary")


def item_type(items: DataFrame, item_id: str) -> str:
    return "long" if items.schema[item_id].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Limits:
    """A hit span of more than ``longest`` words is removed; a document of which more than ``coverage`` is hit goes as a whole.

    Every hit span holds a window or a whole item, so the default keeps only items of one or two words, which clean text has too.
    """

    longest: int = 2
    coverage: float = 0.5


def find_contamination(
    docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), window: int = 10, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``keep`` columns of every document with ``text, n_words, hits, found, longest``.

    ``hits`` are the merged word ranges that lie in an occurrence of an item's window, ``found``
    the ids of these items, ``longest`` the longest match in words.  Texts stream through the
    automaton; a vectorised look at word pairs skips what no item holds.  The items are
    dealt into automata of bounded size, which tasks build and store; each is broadcast and run in
    turn over all documents, so no item and no document is left out, no document is shuffled and
    a task holds one automaton.  A very long text is one piece of work for a task.

    Words are runs of ASCII letters (A-Z folded), digits and non-ASCII characters.  Null or empty
    texts have no words and no hits; items without words match nothing; an item with a null id
    counts as a hit but is not listed; other than whole-number ids are listed as texts.  An empty
    table of documents gives an empty one, an empty table of items no hits.  Repeated items count once, repeated documents are each
    reported.  No other column is read.
    """
    context = docs.sparkSession.sparkContext
    kind = item_type(items, item_id)
    out = docs.select(
        *keep, F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("hits"),
        F.array().cast(f"array<{kind}>").alias("found"), F.lit(0).alias("longest"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    built = materialize(automata(items, item_id, item_text, window, shard_words), "automata")
    numbers = sorted(r["shard"] for r in built.select("shard").collect())
    # Without items there is an automaton all the same, which counts the words.
    for i, shard in enumerate(numbers or [None]):
        # One automaton, of bounded size, passes through the driver at a time, as the bytes that a task made.
        data = built.where(F.col("shard") == shard).first()["data"] if numbers else zlib.compress(pickle.dumps(Automaton([], window)))
        if i:
            # What the shards before found is written, so that a task never holds two automata.
            out = materialize(out, "hits")
        out = out.mapInArrow(_scan(context.broadcast(data), "text"), schema)
    return out


def _cut(limits: Limits, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                w = words(part.column(text), ALNUM, LOWER)
                texts = part.column(text).to_pylist()
                for i, (value, spans) in enumerate(zip(texts, part.column("hits").to_pylist())):
                    if spans:
                        first, data = int(w.first[i]), value.encode()
                        base, at, kept = int(w.offsets[i]), 0, []
                        for s in spans:
                            if s["end"] - s["start"] > limits.longest:
                                kept.append(data[at : int(w.start[first + s["start"]]) - base])
                                at = int(w.end[first + s["end"] - 1]) - base
                        texts[i] = b"".join([*kept, data[at:]]).decode()
                columns = [pa.array(texts, part.column(n).type) if n == text else part.column(n) for n in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, limits: Limits = Limits(), columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The given columns of the documents with contaminated spans cut from ``text``.

    A hit span longer than ``limits.longest`` words is cut, whole short items among them; a document whose hit words are more
    than ``limits.coverage`` of its words is left out.  Documents without hits are unchanged.
    Null and empty texts stay as they are.  ``columns`` that are named ``n_words``, ``hits``, ``found``
    or ``longest`` are refused, as the search uses these names.
    """
    taken = {"n_words", "hits", "found", "longest"} & set(columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} have names that the search uses")
    found = find_contamination(docs, items, [c for c in columns if c != "text"], window)
    share = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])) / F.greatest("n_words", F.lit(1))
    found = found.where(share <= limits.coverage).drop("n_words", "found", "longest")
    return found.mapInArrow(_cut(limits, "text"), found.schema).select(*columns)


