"""Near-duplicates by BagMinHash signatures of word shingles, with verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .graph import components
from .text import BASE, BASE_2, BLANK, SAME, chunks, mix, run_hashes, words

# Bits of a shingle's hash beside the number of its text within a chunk.
HASH_BITS = 44
# Slots of the approximate shingle counts that order tokens by rarity.
SLOTS = 1 << 18
# Bands whose leaders are verified first; most members need no others.
FIRST_BANDS = 3
GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Shape:
    """Shingles of ``words`` words; signatures of ``bands * rows`` values; links from ``similarity`` up.

    A pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** rows) ** bands, which is
    0.999993 here.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 30
    rows: int = 5

    @property
    def slots(self) -> int:
        return self.bands * self.rows


@dataclass
class Bags:
    """Multisets of shingles: text, shingle and count of each distinct shingle, and the size of each text's multiset."""

    doc: np.ndarray
    key: np.ndarray
    count: np.ndarray
    weight: np.ndarray


def bags(column: pa.Array, size: int) -> Bags:
    """The shingles of ``size`` words of each text; a text of fewer words, but not none, is one shingle."""
    w = words(column, BLANK, SAME)
    n = np.diff(w.first)
    hashes, docs = [run_hashes(w.hash, size)], []
    doc = w.doc
    inside = doc[: len(hashes[0])] == doc[size - 1 :] if len(hashes[0]) else np.zeros(0, bool)
    hashes[0], docs = hashes[0][inside], [doc[: len(inside)][inside]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        value = np.full(len(short), BASE_2 + k & (1 << 64) - 1, dtype=np.uint64)
        for i in range(k):
            value = value * np.uint64(BASE) + w.hash[w.first[short] + i]
        hashes.append(mix(value))
        docs.append(short)
    doc, value = np.concatenate(docs).astype(np.uint64), np.concatenate(hashes)
    key, count = np.unique((doc << np.uint64(HASH_BITS)) | (value >> np.uint64(64 - HASH_BITS)), return_counts=True)
    weight = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    return Bags((key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), count, weight)


def _points(element: np.ndarray, block: np.ndarray, rate: np.ndarray, until: np.ndarray, slots: int):
    """The points of each element's Poisson process, in order, up to a time: (element number, time, slot, mark).

    A point depends only on the element, the block of weights and its number in the process, so
    any two texts see the same points.
    """
    seed = mix(element + block.astype(np.uint64) * np.uint64(BASE_2))
    alive, time, k = np.arange(len(element)), np.zeros(len(element)), 0
    while len(alive):
        # Few long processes are drawn many points at a time; the sums stay in the same order.
        step = 1 if len(alive) > 4096 else 16
        number = np.arange(k, k + step, dtype=np.uint64)
        draw = mix(seed[alive][:, None] + (number[None, :] + np.uint64(1)) * GOLD)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        gaps = -np.log(uniform) / rate[alive][:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        before = times < until[alive][:, None]
        row, col = np.nonzero(before)
        mark = mix(draw[row, col] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        yield alive[row], times[row, col], (mark % np.uint64(slots)).astype(np.int64), mark
        go = before[:, -1]
        alive, time, k = alive[go], times[go, -1], k + step


def signatures(b: Bags, slots: int) -> np.ndarray:
    """BagMinHash values (texts x slots); equal in a slot with probability weighted Jaccard.

    Whole weights are levels 0, 1, 2 ...; level blocks [0, 1), [1, 2), [2, 4), [4, 8) ... each carry a
    Poisson process whose rate is the block's size, whose points fall on the slots at random and on
    the block's levels at random.  A text of weight w keeps the points below level w: of whole
    blocks all, of the last one a thinned part, so a weight costs its logarithm.  A slot's value is
    its first point.  Points are drawn only up to the time by which all slots are expected to be
    filled; texts with an empty slot go on to twice that time.
    """
    out = np.full((len(b.weight), slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    todo = b.weight > 0
    reach = np.where(todo, slots / np.maximum(b.weight, 1) * (np.log(slots) + 4.0), 0.0)
    top = int(b.count.max(initial=0))
    blocks = [(0, 0, 1)] + [(i + 1, 1 << i, 1 << i) for i in range(max(top - 1, 0).bit_length())]
    while todo.any():
        flat = out.ravel()
        for number, low, size in blocks:
            mine = np.flatnonzero(todo[b.doc] & (b.count > low))
            if not len(mine):
                continue
            doc, count = b.doc[mine], b.count[mine]
            element = mix(b.key[mine])
            for at, time, slot, mark in _points(element, np.full(len(mine), number), np.full(len(mine), float(size)), reach[doc], slots):
                level = low + ((mark >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
                keep = level < count[at]
                at, time, slot, mark = at[keep], time[keep], slot[keep], mark[keep]
                value = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mark & np.uint64(0xFFFFFFFF))
                np.minimum.at(flat, doc[at] * slots + slot, value)
        todo = todo & (out == np.iinfo(np.uint64).max).any(axis=1)
        reach = reach * 2
    return out


def _sign(text: str, shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                b = bags(part.column(text), shape.words)
                values = signatures(b, shape.slots).reshape(len(b.weight), shape.bands, shape.rows)
                band = np.full(values.shape[:2], np.uint64(BASE), dtype=np.uint64) + np.arange(shape.bands, dtype=np.uint64)[None, :]
                for i in range(shape.rows):
                    band = mix(band * np.uint64(BASE_2) + values[:, :, i])
                full = b.weight > 0
                ends = np.concatenate(([0], np.cumsum(full * shape.bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[full].ravel().view(np.int64)))
                keep = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(b.weight), lists], names=[*keep, "weight", "bands"])

    return run


def overlap(left: Bags, right: Bags) -> np.ndarray:
    """Per text the size of the multiset intersection of its two bags."""
    code = lambda x: (x.doc.astype(np.uint64) << np.uint64(HASH_BITS)) | x.key
    _, i, j = np.intersect1d(code(left), code(right), assume_unique=True, return_indices=True)
    return np.bincount(left.doc[i], np.minimum(left.count[i], right.count[j]), len(left.weight)).astype(np.int64)


def _verify(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_a"):
                left, right = bags(part.column("text_a"), shape.words), bags(part.column("text_b"), shape.words)
                both = overlap(left, right)
                linked = both >= shape.similarity * (left.weight + right.weight - both) - 1e-9
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(linked)) for c in ("a", "b")], names=["a", "b"])

    return run


def _slot_counts(batches: Iterator[pa.RecordBatch], size: int) -> np.ndarray:
    counts = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for part in chunks(batch, "text"):
            counts += np.bincount((bags(part.column("text"), size).key % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    return counts


def _count(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _slot_counts(batches, shape.words)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["slot", "n"])

    return run


def prefix_length(weight: np.ndarray, similarity: float) -> np.ndarray:
    """So many first tokens of a bag, in any order common to all, hold one token of every similar bag."""
    return weight - np.ceil(similarity * weight - 1e-9).astype(np.int64) + 1


def _prefix(shared, shape: Shape):
    """The rarest tokens of each text: (token, vid, place, weight, root, stray).

    The i-th copy of a shingle is a token of its own, so that overlaps of multisets are overlaps
    of sets.  How rare a token is comes from counts of hashed slots; a poor count costs time, no
    link, as any order will do that is the same for all texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                b = bags(part.column("text"), shape.words)
                one = np.repeat(np.arange(len(b.key)), b.count)
                copy = np.arange(len(one)) - np.repeat(np.cumsum(b.count) - b.count, b.count)
                token = mix(b.key[one] + copy.astype(np.uint64) * GOLD)
                doc = b.doc[one]
                order = np.lexsort((token, counts[(b.key[one] % np.uint64(SLOTS)).astype(np.int64)], doc))
                first = np.cumsum(b.weight) - b.weight
                place = np.arange(len(one)) - first[doc]
                keep = place < prefix_length(b.weight, shape.similarity)[doc]
                rows = pa.array(doc[keep])
                columns = [pa.array(token[order][keep].view(np.int64)), part.column("vid").take(rows), pa.array(place[keep])]
                columns += [pa.array(b.weight[doc[keep]]), part.column("root").take(rows), part.column("stray").take(rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "vid", "place", "weight", "root", "stray"])

    return run


class Links:
    """Verified links between distinct texts, found bucket by bucket without pairing off whole buckets."""

    def __init__(self, docs: DataFrame, shape: Shape, text: str):
        self.shape = shape
        body = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(F.col("doc_id"), F.unhex(F.md5(body.cast("binary"))).alias("key"), body.alias("text"))
        schema = T.StructType([*rows.schema.fields[:2], T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
        self.signed = materialize(rows.mapInArrow(_sign("text", shape), schema), "signed")
        # One vertex per distinct text.  Its number is fixed by being written.
        texts = self.signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
        self.texts = materialize(texts.withColumn("vid", F.monotonically_increasing_id()), "texts")
        self.members = self.texts.select("vid", "weight", F.posexplode("bands").alias("band", "bucket"))
        # The leader of a bucket is its smallest member in an order that differs from bucket to bucket.
        order = F.col("vid").bitwiseXOR(F.col("bucket"))
        sizes = self.members.groupBy("bucket").agg(F.min(order).alias("lead"), F.max(order).alias("last"))
        sizes = sizes.where("lead <> last").select("bucket", F.col("lead").bitwiseXOR(F.col("bucket")).alias("leader"))
        self.buckets = materialize(sizes, "buckets")
        self.shared = materialize(self.members.join(self.buckets, "bucket"), "shared")
        involved = self.shared.select("vid").distinct().join(self.texts.select("vid", "key", "first_id"), "vid")
        # Copies of a text are many, its first document is one (repeated rows of it carry the same text).
        found = rows.join(involved, (rows["key"] == involved["key"]) & rows["doc_id"].eqNullSafe(involved["first_id"]))
        self.bodies = materialize(found.select("vid", "text"), "bodies")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose multisets of shingles are similar enough."""
        one, two = self.bodies.select(F.col("vid").alias("a"), F.col("text").alias("text_a")), self.bodies.select(F.col("vid").alias("b"), F.col("text").alias("text_b"))
        texts = pairs.select("a", "b").join(two, "b").join(one, "a")
        return materialize(texts.mapInArrow(_verify(self.shape), "a long, b long").distinct(), "links")

    def could_link(self, a: Column, b: Column) -> Column:
        """Multisets of very different size cannot be similar."""
        return F.least(a, b) >= self.shape.similarity * F.greatest(a, b) - 1e-9

    def prefix_pairs(self, crowd: DataFrame) -> DataFrame:
        """Pairs (a, b) of a stray and a text of another component that share a rare token early enough to be similar.

        An exact filter: two bags with the needed overlap share a token within both prefixes, and
        what follows the first such token must suffice for the overlap.  Strays whose rare
        shingles are their own meet nobody, however large the crowd around them is.
        """
        texts = materialize(self.bodies.join(crowd, "vid").select("vid", "root", "stray", "text"), "crowd")
        counts = np.zeros(SLOTS, dtype=np.int64)
        counted = texts.select("text").mapInArrow(_count(self.shape), "slot int, n long")
        for r in counted.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
            counts[r["slot"]] = r["n"]
        shared = texts.sparkSession.sparkContext.broadcast(counts)
        schema = "token long, vid long, place long, weight long, root long, stray boolean"
        tokens = materialize(texts.mapInArrow(_prefix(shared, self.shape), schema), "prefixes")
        x, y = tokens.where("stray").alias("x"), tokens.alias("y")
        t = self.shape.similarity
        need = F.ceil(F.lit(t / (1 + t)) * (F.col("x.weight") + F.col("y.weight")) - 1e-9)
        left = F.least(F.col("x.weight") - F.col("x.place"), F.col("y.weight") - F.col("y.place"))
        fits = self.could_link(F.col("x.weight"), F.col("y.weight")) & (left >= need)
        once = ~F.col("y.stray") | (F.col("x.vid") < F.col("y.vid"))
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & fits)
        return met.select(F.least("x.vid", "y.vid").alias("a"), F.greatest("x.vid", "y.vid").alias("b")).distinct()

    def star(self, shared: DataFrame) -> DataFrame:
        """Each member with its bucket's leader, once per pair."""
        heads = self.texts.select(F.col("vid").alias("leader"), F.col("weight").alias("lead_weight"))
        pairs = shared.where("vid <> leader").select("vid", "weight", "leader").distinct().join(heads, "leader")
        pairs = pairs.where(self.could_link(F.col("weight"), F.col("lead_weight")))
        return pairs.select(F.least("vid", "leader").alias("a"), F.greatest("vid", "leader").alias("b")).distinct()


def _rooted(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    joined = df.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left")
    return joined.withColumn(name, F.coalesce(name, column))


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` are added to those of ``roots``."""
    ends = _rooted(_rooted(links, roots, "a", "ra"), roots, "b", "rb")
    joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    nodes = roots.union(links.select(F.col("a").alias("node"), F.col("a").alias("root"))).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")))
    nodes = nodes.groupBy("node").agg(F.min("root").alias("root"))
    return materialize(_rooted(nodes, joined, "root", "new").select("node", F.col("new").alias("root")), "roots")


def text_classes(docs: DataFrame, shape: Shape = Shape(), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, key`` of all documents, and ``key, root, first_id`` of all distinct texts."""
    found = Links(docs, shape, text)
    roots = components(found.verify(found.star(found.shared.where(F.col("band") < FIRST_BANDS))))

    # All buckets again, but only for members that are not yet in the leader's component.
    apart = _rooted(_rooted(found.shared, roots, "vid", "rv"), roots, "leader", "rl").where("rv <> rl")
    roots = _merge(roots, found.verify(found.star(apart)))

    # What is left: members apart from their leader could still be linked to others of the crowd.
    placed = _rooted(_rooted(found.shared, roots, "vid", "rv"), roots, "leader", "rl")
    placed = materialize(placed.select("bucket", "vid", "rv", (F.col("rv") != F.col("rl")).alias("apart")), "placed")
    crowds = placed.where("apart").select("bucket").distinct()
    crowd = placed.join(crowds, "bucket", "left_semi").groupBy("vid").agg(F.first("rv").alias("root"), F.max("apart").alias("stray"))
    roots = _merge(roots, found.verify(found.prefix_pairs(crowd)))
    vertices = _rooted(found.texts.select("key", "vid", "first_id"), roots, "vid", "root")
    return found.signed.select("doc_id", "key"), vertices.select("key", "root", "first_id")


def near_duplicates(docs: DataFrame, shape: Shape = Shape(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` for every document; the class id is the smallest id of its class.

    Texts are linked if the weighted Jaccard similarity of their multisets of word shingles is at
    least ``shape.similarity``; classes are the connected components.  Equal texts are one vertex,
    so copies are never paired.  Banded BagMinHash signatures give buckets; each member is
    verified against its bucket's leader, which joins most near copies.  Members that stay apart
    from their leader are joined with the rest of these buckets on rare shingles, by an exact prefix
    filter, so no link within a bucket is lost and no bucket is paired off.

    Null texts count as empty, and empty texts are equal to each other; texts without words are
    linked to equal texts only.  Null ids never name a class unless all ids of the class are null.
    Repeated rows get the same class.  Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows, vertices = text_classes(docs, shape)
    names = vertices.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = materialize(vertices.join(names, "root").select("key", "class_id"), "classes")
    return rows.join(classes, "key").select("doc_id", "class_id")


def keep_one(docs: DataFrame, columns: Sequence[str], shape: Shape = Shape()) -> DataFrame:
    """The given columns of one document of each class: the one of smallest id, null last; of equal rows one."""
    rows, vertices = text_classes(docs.select("doc_id", "text"), shape)
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")).alias("best")
    chosen = vertices.groupBy("root").agg(best).select(F.col("best.key").alias("_key"), F.col("best.first_id").alias("_id"))
    copies = rows.groupBy("key", "doc_id").count().select(F.col("key").alias("_key"), F.col("doc_id").alias("_id2"), F.col("count").alias("_n"))
    chosen = materialize(chosen.join(copies, (chosen["_key"] == copies["_key"]) & chosen["_id"].eqNullSafe(copies["_id2"])).select(chosen["_key"], "_id", "_n"), "chosen")
    marked = docs.select(*columns, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_k"), F.col("doc_id").alias("_d"))
    kept = marked.join(chosen, (marked["_k"] == chosen["_key"]) & marked["_d"].eqNullSafe(chosen["_id"]))
    once = kept.where("_n = 1").select(*columns)
    # Only rows whose id and text occur more than once need to be compared.
    again = kept.where("_n > 1").dropDuplicates(["_key"]).select(*columns)
    return once.unionByName(again)
