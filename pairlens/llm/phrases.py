"""Phrase collocations from count transducers: built per shard, united by prefix range, composed to look up parts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import materialize
from .automata import Trie, compose, cut, from_paths, from_positions, pack, prefix_range, prune, union, unpack
from .text import LOWER, MASK, chunks, words

# Words of a shard, bytes of text whose sequences make a range, and nodes that wait to be united.
SHARD_WORDS, RANGE_BYTES, WAITING = 1_000_000, 16 << 20, 2_000_000
# Parts that make up this share of all words are looked up without being moved: at most 1 / share of each length exist.
HOT_SHARE = 1 / 2048
# Parts in which the best phrases of a language are found before they meet.
TOP_PARTS = 16
# What ends a piece of text, and what separates its words.
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"

END = np.isin(np.arange(256), np.frombuffer(ENDS, np.uint8))
WORD = ~END & ~np.isin(np.arange(256), np.frombuffer(GAPS, np.uint8))


def lang_key(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


class Shard:
    """The words of some texts until their sequences are counted."""

    def __init__(self, longest: int):
        self.longest, self.size = longest, 0
        self.langs: dict[str, int] = {}
        self.hashes, self.linked, self.lang, self.seen = [], [], [], []

    def add(self, text: pa.Array, langs: list[str]) -> None:
        w = words(text, WORD, LOWER)
        n = len(w.hash)
        doc = w.doc
        ends = np.append(0, np.cumsum(END[w.data]))
        linked = np.zeros(n, dtype=bool)  # whether the next word follows within the piece
        if n > 1:
            linked[:-1] = (doc[1:] == doc[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1]])
        number = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], dtype=np.int64)
        self.hashes.append(w.hash)
        self.linked.append(linked)
        self.lang.append(number[doc] if n else np.zeros(0, np.int64))
        self.size += n
        kinds, at = np.unique(w.hash, return_index=True)
        order = np.argsort(at)
        start, end = w.start[at[order]], w.end[at[order]]
        mark = np.zeros(len(w.data) + 1, dtype=np.int8)
        mark[start] += 1
        mark[end] -= 1
        letters = LOWER[w.data[np.cumsum(mark[:-1], dtype=np.int8) > 0]]
        offsets = np.append(0, np.cumsum(end - start)).astype(np.int32)
        texts = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        self.seen.append((kinds[order], texts))

    def trie(self) -> Trie:
        hashes, linked, lang = np.concatenate(self.hashes), np.concatenate(self.linked), np.concatenate(self.lang)
        labels, symbol = np.unique(hashes, return_inverse=True)
        names = list(self.langs)
        firsts = np.array([lang_key(x) for x in names], dtype=np.uint64)
        order = np.argsort(firsts)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        # Each chain says where in the one before its sequences begin.
        chains, at = [(rank[lang], symbol)], np.arange(len(symbol))
        for step in range(1, self.longest):
            inside = np.flatnonzero(linked[at + step - 1])
            chains.append((inside, symbol[at[inside] + step]))
            at = at[inside]
        levels = from_positions(chains, labels, firsts[order])
        kinds, place = np.unique(np.concatenate([k for k, _ in self.seen]), return_index=True)
        texts = pa.concat_arrays([t for _, t in self.seen]).take(pa.array(place))
        return Trie(levels, texts.take(pa.array(np.searchsorted(kinds, levels[1].label))))


def _shards(longest: int, bits: int):
    def emit(shard: Shard) -> Iterator[pa.RecordBatch]:
        langs = {str(lang_key(x)): x for x in shard.langs}
        for r, part in cut(shard.trie(), bits):
            mine = {str(k): langs[str(k)] for k in part.levels[0].label.tolist()}
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([pack(part, langs=mine)], pa.binary())], names=["range", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(longest)
        for batch in batches:
            for part in chunks(batch, "text"):
                shard.add(part.column("text"), part.column("lang").to_pylist())
                if shard.size >= SHARD_WORDS:
                    yield from emit(shard)
                    shard = Shard(longest)
        if shard.size:
            yield from emit(shard)

    return run


def _names(longest: int) -> tuple[list[str], list[str], list[str]]:
    return [f"w{d}" for d in range(longest)], [f"left{k}" for k in range(1, longest)], [f"right{k}" for k in range(1, longest)]


def _schema(longest: int) -> T.StructType:
    """Rows of all kinds: united automata, languages, words and phrases."""
    longs = [n for part in _names(longest) for n in part]
    fields = [("kind", T.StringType()), ("range", T.IntegerType()), ("data", T.BinaryType()), ("name", T.StringType()), ("lang", T.LongType()), ("size", T.IntegerType()), ("a", T.LongType())]
    return T.StructType([*(T.StructField(n, t) for n, t in fields), *(T.StructField(n, T.LongType()) for n in longs)])


def _batch(n: int, longest: int, **columns) -> pa.RecordBatch:
    """``n`` rows of the schema; columns that are not given are null, numbers 0."""
    out, names = [], []
    for f in _schema(longest).fields:
        value = columns.get(f.name)
        if isinstance(f.dataType, T.StringType):
            value = pa.array([value] * n, pa.string()) if value is None or isinstance(value, str) else value
        elif isinstance(f.dataType, T.BinaryType):
            value = pa.array(value or [None] * n, pa.binary())
        else:
            kind = pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()
            value = np.full(n, 0 if value is None else value) if value is None or np.isscalar(value) else value
            value = pa.array(value.view(np.int64) if value.dtype == np.uint64 else value).cast(kind)
        out.append(value)
        names.append(f.name)
    return pa.RecordBatch.from_arrays(out, names=names)


def _texts(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.string())


def _finish(r: int, trie: Trie, langs: dict[str, str], longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """What is left of a united range: its automaton, its languages and words, and its phrases with the counts of their beginnings."""
    first = trie.levels[0]
    yield _batch(len(first), longest, kind="lang", lang=first.label, a=first.weight, name=pa.array([langs[str(k)] for k in first.label.tolist()], pa.string()))
    trie = prune(trie, least)
    yield _batch(1, longest, kind="counts", range=r, data=[pack(trie)])
    ones = trie.levels[1]
    spoken = np.flatnonzero(ones.weight >= least)
    lang = trie.levels[0].label[ones.parent]
    yield _batch(len(spoken), longest, kind="word", lang=lang[spoken], w0=ones.label[spoken], a=ones.weight[spoken], name=_texts(trie.texts.take(pa.array(spoken))))
    known = {"lang": lang, "w0": ones.label}
    for d, level in enumerate(trie.levels[2:], 1):
        known = {k: v[level.parent] for k, v in known.items()}
        yield _batch(len(level), longest, kind="phrase", size=d + 1, a=level.weight, **known, **{f"w{d}": level.label})
        known |= {f"w{d}": level.label, f"left{d + 1}": level.weight}


def _unite(longest: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, size, langs = None, [], 0, {}
        for batch in batches:
            for r, data in zip(batch.column("range").to_pylist(), batch.column("data")):
                if r != now and waiting:
                    yield from _finish(now, union(waiting), langs, longest, least)
                    waiting, size, langs = [], 0, {}
                now = r
                trie, head = unpack(data.as_py())
                langs |= head["langs"]
                waiting.append(trie)
                size += trie.size
                # Uniting at a doubled size touches each node a few times only.
                if size > WAITING and size > 2 * waiting[0].size:
                    waiting = [union(waiting)]
                    size = waiting[0].size
        if waiting:
            yield from _finish(now, union(waiting), langs, longest, least)

    return run


def _labels(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


class Lookup:
    """One step of the composition: the count of the first word (step 0), or of all from word ``step`` on."""

    def __init__(self, longest: int, bits: int, step: int):
        self.longest, self.bits, self.step = longest, bits, step
        self.column = "left1" if step == 0 else f"right{step}"

    def parts(self, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Paths of the parts, their lengths, and which rows still ask for one."""
        w = [_labels(batch, f"w{d}") for d in range(self.longest)]
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.ones(len(size), np.int64) if self.step == 0 else size - self.step
        path = [_labels(batch, "lang"), *(w[d] for d in range(self.step, self.longest))]
        asks = (length > 0) & (batch.column(self.column).to_numpy(zero_copy_only=False) == 0)
        return path, length, asks

    def fill(self, batch: pa.RecordBatch, trie: Trie) -> pa.RecordBatch:
        path, length, asks = self.parts(batch)
        found = compose(trie, path, np.where(asks, length + 1, 0))
        value = np.where(asks, found, batch.column(self.column).to_numpy(zero_copy_only=False))
        return batch.set_column(batch.schema.get_field_index(self.column), self.column, pa.array(value))

    def send(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Set the range where each part's count is kept; rows that ask for nothing are spread."""
        path, length, asks = self.parts(batch)
        second = path[2] if len(path) > 2 else path[1]
        spread = reduce(lambda x, d: x * np.uint64(31) + _labels(batch, f"w{d}"), range(self.longest), _labels(batch, "lang"))
        to = np.where(length > 1, prefix_range(path[1], second, self.bits), prefix_range(path[1], None, self.bits))
        to = np.where(asks, to, prefix_range(spread, None, self.bits))
        return batch.set_column(batch.schema.get_field_index("range"), "range", pa.array(to, pa.int32()))


def _ask(step: Lookup, hot: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, _ = unpack(hot)
        for batch in batches:
            yield step.send(step.fill(batch, common))

    return run


def _answer(step: Lookup, after: Lookup | None, hot: bytes):
    """Compose each range's automaton, which comes first, with the phrases that were sent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, _ = unpack(hot)
        now, trie = None, None
        for batch in batches:
            ranges = batch.column("range").to_numpy(zero_copy_only=False)
            tables = np.asarray(pc.equal(batch.column("kind"), "counts"))
            edges = np.flatnonzero(np.concatenate(([True], (ranges[1:] != ranges[:-1]) | tables[1:] | tables[:-1], [True])))
            for at, upto in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if tables[at]:
                    now, trie = ranges[at], unpack(batch.column("data")[at].as_py())[0]
                    continue
                part = batch.slice(at, upto - at)
                if now == ranges[at]:
                    part = step.fill(part, trie)
                yield after.send(after.fill(part, common)) if after else part

    return run


def count_phrases(docs: DataFrame, lang: str, text: str, longest: int, least: int) -> tuple[DataFrame, int]:
    """One table with the united automata, languages, words and phrases of ``least`` occurrences, and the bits of a range."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(size // RANGE_BYTES).bit_length())
    shards = rows.mapInArrow(_shards(longest, bits), "range int, data binary")
    # A range is a partition of its own, so that none waits for another in one task.
    dealt = shards.repartitionById(1 << bits, F.col("range")).sortWithinPartitions("range")
    return materialize(dealt.mapInArrow(_unite(longest, least), _schema(longest)), "phrase-counts"), bits


def _hot(counted: DataFrame, longest: int) -> bytes:
    """An automaton of the most common sequences of all languages, at most ``longest / HOT_SHARE`` of them."""
    total = counted.where("kind = 'lang'").agg(F.sum("a")).first()[0] or 0
    ws, _, _ = _names(longest)
    common = counted.where("kind IN ('word', 'phrase')").where(F.col("a") >= max(1, int(np.ceil(total * HOT_SHARE))))
    paths = {}
    for r in common.select("lang", "size", "a", *ws).collect():
        paths[tuple(x & MASK for x in (r["lang"], *(r[w] for w in ws[: max(r["size"], 1)])))] = r["a"]
    return pack(from_paths(paths, longest + 1))


def phrases_with_parts(docs: DataFrame, lang: str, text: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """All phrases with the counts of both parts of every cut, and the table they come from."""
    counted, bits = count_phrases(docs, lang, text, longest, least)
    hot, schema = _hot(counted, longest), _schema(longest)
    steps = [Lookup(longest, bits, k) for k in range(longest)]
    tables, found = counted.where("kind = 'counts'"), counted.where("kind = 'phrase'")
    found = found.mapInArrow(_ask(steps[0], hot), schema)
    for step, after in zip(steps, [*steps[1:], None]):
        dealt = tables.unionAll(found).repartitionById(1 << bits, F.col("range")).sortWithinPartitions("range", "kind")
        found = dealt.mapInArrow(_answer(step, after, hot), schema)
    return found, counted


def _covered(phrases: DataFrame, longest: int, share: int) -> DataFrame:
    """``size, lang, w..., longer``: the highest count of a longer phrase around each phrase, where it is ``share`` percent or more."""
    ws, _, _ = _names(longest)
    inner = []
    for size in range(3, longest + 1):
        for n in range(2, size):
            for at in range(size - n + 1):
                part = [F.col(ws[at + d]).alias(ws[d]) if d < n else F.lit(0).cast("long").alias(ws[d]) for d in range(longest)]
                inner.append(phrases.where(F.col("size") == size).select(F.lit(n).alias("size"), "lang", *part, F.col("a").alias("longer")))
    if not inner:
        return phrases
    keys = ["size", "lang", *ws]
    around = reduce(DataFrame.unionAll, inner).groupBy(*keys).agg(F.max("longer").alias("longer"))
    joined = phrases.join(around, keys, "left")
    return joined.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")


def _best_cut(longest: int) -> Column:
    """The cut of lowest score, the first of them: ``score, k, l, r``; whole numbers of 38 digits, divided without rounding."""
    cuts = []
    for k in range(1, longest):
        l, r = F.col(f"left{k}"), F.col(f"right{k}")  # noqa: E741
        score = F.expr(f"(CAST(1000000 AS DECIMAL(8, 0)) * CAST(CAST(a AS DECIMAL(19, 0)) * a AS DECIMAL(30, 0))) div CAST(CAST(left{k} AS DECIMAL(19, 0)) * right{k} AS DECIMAL(38, 0))")
        cuts.append(F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    return F.array_min(F.array_compact(F.array(*cuts)))


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of 2 to ``longest`` words that stand together, best first in each language.

    ``a`` counts a phrase's occurrences within pieces of text, ``l`` and ``r`` those of its two parts
    at the cut that scores lowest, ``n`` all words of the language; ``score`` is
    floor(10^6 a a / (l r)).  Phrases of fewer than ``least`` occurrences do not count, and one
    that stands inside a longer phrase in ``inside`` percent of its occurrences is left out.  ``top``
    is the length of each language's list; without it all phrases are returned and rank is null.

    A-Z are lower-cased; pieces end at ``ENDS`` and words are separated by ``GAPS``.  A null text
    has no words, a null language is ``und``.  Repeated rows count each.  Words are told apart by
    64-bit hashes.  Equal scores are ordered by ``a``, then by the phrase's bytes, so reruns agree.
    Other columns are ignored; an empty table gives an empty one.
    """
    ws, _, _ = _names(longest)
    found, counted = phrases_with_parts(docs, lang, text, longest, least)
    found = materialize(found.drop("kind", "range", "data", "name"), "phrases")
    scored = _covered(found, longest, inside).withColumn("cut", _best_cut(longest))
    order = [F.col("cut.score").desc(), F.col("a").desc()]
    if top is not None:
        # Ties stay until the words are known.  Parts of a language give up what cannot be in its list first.
        scored = scored.withColumn("part", F.pmod(F.xxhash64(*ws), F.lit(TOP_PARTS)))
        for keys in (["lang", "part"], ["lang"]):
            scored = scored.withColumn("place", F.rank().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= top)
    known = counted.where("kind = 'word'")
    for d, w in enumerate(ws):
        named = known.select("lang", F.col("w0").alias(w), F.col("name").alias(f"text{d}"))
        scored = scored.join(named, ["lang", w], "left")
    langs = counted.where("kind = 'lang'").groupBy("lang").agg(F.max("name").alias("language"), F.sum("a").alias("n"))
    spoken = F.array_join(F.slice(F.array(*[f"text{d}" for d in range(longest)]), 1, F.col("size")), " ")
    out = scored.join(langs, "lang").select(
        F.col("language").alias("lang"), spoken.alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    if top is None:
        return out.withColumn("rank", F.lit(None).cast("long")).select(*columns)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase")))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(*columns)
