"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .boosting import sigmoid
from .sums import BLOCKS, blocks, bounded_sample, task_number, total
from .text import ALNUM, SAME, chunks, words

# Tokens are hashed into this many slots, each with a vector of DIM numbers.
SLOTS, DIM, NONZERO = 1 << 14, 32, 2
# Tokens apart at which a text's vectors are compared with each other: one and two words, as separators stand between them.
APART = (2, 4)
WIDTH = DIM + len(APART)
WORD = ALNUM.copy()
WORD[0x41:0x5B] = True


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each slot's sparse random index vector; the same in every task."""
    rng = np.random.default_rng(20)
    return rng.integers(0, DIM, (SLOTS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (SLOTS, NONZERO))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all tokens in text order, and their texts' first tokens.

    Tokens are the words as they are written and what separates them (punctuation with its
    blanks), so wording, capitals and typography all have vectors.
    """
    w, s = words(column, WORD, SAME), words(column, ~WORD, SAME)
    start = np.concatenate((w.start, s.start))
    order = np.argsort(start, kind="stable")
    slot = (np.concatenate((w.hash, s.hash ^ np.uint64(0x5E9A)))[order] & np.uint64(SLOTS - 1)).astype(np.int64)
    return slot, w.first + s.first


def pooled(slot: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: the mean of its tokens' vectors, and how alike vectors ``APART`` tokens from each other are (mean cosine).

    ``vectors`` have length 1.  A text without tokens, or too short for a distance, has zeros.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), WIDTH))
    full = np.flatnonzero(n)
    # A few texts at a time, so that their vectors stay in the cache.
    for at in range(0, len(full), 64):
        mine = full[at : at + 64]
        low, high = int(first[mine[0]]), int(first[mine[-1] + 1])
        here = vectors[slot[low:high]]
        begin = first[mine] - low
        out[mine, :DIM] = np.add.reduceat(here, begin, axis=0)
        for j, gap in enumerate(APART):
            if high - low > gap:
                alike = np.einsum("ij,ij->i", here[:-gap], here[gap:]) * (doc[low : high - gap] == doc[low + gap : high])
                out[mine, DIM + j] = np.add.reduceat(np.append(alike, np.zeros(gap)), begin)
    out[:, :DIM] /= np.maximum(n, 1)[:, None]
    out[:, DIM:] /= np.maximum(n[:, None] - np.array(APART), 1)
    return out


def _contexts(text: str):
    """Sum, for every slot, the index vectors of its neighbours up to two tokens away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        sums = np.zeros(SLOTS * DIM)
        for batch in batches:
            for part in chunks(batch, text):
                slot, first = tokens(part.column(text))
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for gap in (1, 2):
                    near = doc[gap:] == doc[:-gap]
                    left, right = slot[:-gap][near], slot[gap:][near]
                    for to, by in ((left, right), (right, left)):
                        for j in range(NONZERO):
                            sums += np.bincount(to * DIM + place[by, j], sign[by, j], SLOTS * DIM)
        yield blocks(sums, task_number())

    return run


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """One vector of length 1 per slot, from the neighbours of its tokens in all documents plus the slot's own index vector."""
    sums = total(docs.select(F.col(text).alias("text")).mapInArrow(_contexts("text"), BLOCKS), SLOTS * DIM).reshape(SLOTS, DIM)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    own = np.zeros((SLOTS, DIM), dtype=np.float32)
    place, sign = index_vectors()
    np.add.at(own, (np.arange(SLOTS)[:, None], place), sign / np.sqrt(NONZERO))
    both = sums / np.maximum(norm, 1e-9) + own
    return (both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                x = pooled(*tokens(part.column(text)), shared.value).astype(np.float32)
                keep = [c for c in part.schema.names if c != text]
                feats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), feats], names=[*keep, "x"])

    return run


def pooled_features(docs: DataFrame, keep: Sequence[str], shared, text: str = "text") -> DataFrame:
    """``keep`` columns with ``x``: what ``pooled`` makes of the broadcast word vectors, over every whole text."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.ArrayType(T.FloatType()))])
    return rows.mapInArrow(_pool(shared, "_text"), schema)


@dataclass
class Network:
    """One hidden layer over standardised features; the temperature makes its probabilities match held-back labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on four fifths of the rows; the last fifth sets the temperature by log-loss, whatever their number."""
    if len(y) == 0:
        n = WIDTH
        return Network(np.zeros(n), np.ones(n), [np.zeros((n, hidden)), np.zeros(hidden), np.zeros(hidden), np.array(0.0)])
    rng = np.random.default_rng(5)
    held = np.arange(len(y)) % 5 == 4
    tx, ty = x[~held], y[~held]
    net = Network(tx.mean(axis=0), tx.std(axis=0) + 1e-3, [])
    share = (ty.sum() + 0.5) / (len(ty) + 1)
    net.weights = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
        rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(share / (1 - share))),
    ]
    first, second, step = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    z = (tx - net.mean) / net.scale
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            rows = order[at : at + batch]
            a, b, c, d = net.weights
            h = np.tanh(z[rows] @ a + b)
            error = (sigmoid(h @ c + d) - ty[rows]) / len(rows)
            back = np.outer(error, c) * (1 - h * h)
            grads = [z[rows].T @ back + decay * a, back.sum(axis=0), h.T @ error + decay * c, error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.weights[i] = net.weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    if held.any():
        logits = net.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        # One row's worth of belief in a temperature of 1, so that few rows do not set an extreme one.
        loss = [np.sum(np.logaddexp(0, -(2 * y[held] - 1) * logits / t)) + np.log(t) ** 2 / 2 for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, shared, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000) -> Network:
    """Fit on about ``sample`` labelled rows at most, outside the held-out third, chosen by a hash of their id.

    The labels are sampled first and their ids broadcast, so only the texts of the sample are pooled.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("id")))
    chosen = docs.sparkSession.createDataFrame(bounded_sample(known, sample, "id"), known.schema)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "id")
    found = pooled_features(rows, ["id", "y"], shared, "_text").collect()
    rows = sorted(found, key=lambda r: (crc32(str(r["id"]).encode()), r["id"], r["y"], tuple(r["x"])))
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), WIDTH)
    return fit_network(x, np.array([r["y"] for r in rows]))


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n != "x"]
            x = batch.column("x").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(net.probability(x))], names=[*keep, "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Word vectors come from all whole texts, and so does what a text is scored by; only the network is fitted on a
    bounded sample of labelled rows.  The text is the only input of a score.  A null or empty text
    is scored by its zero vector.  Rows that repeat an id are each scored; ids labelled more than
    once count once per label; labels of unknown documents and null labels are ignored.  Without any
    labels every score is 0.5.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = scored_rows(docs, labels.withColumnRenamed(doc_id, "doc_id"), ["doc_id"], sample)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored_rows(docs: DataFrame, labels: DataFrame, columns: Sequence[str], sample: int = 20_000) -> DataFrame:
    """The given columns of every document with its ``score``; texts are pooled and scored where they stand."""
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    net = fit_quality(docs, labels, shared, sample=sample)
    rows = docs.select(*columns, F.col("text").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    pool, score = _pool(shared, "_text"), _score(net)
    # Both steps in one worker.
    return rows.mapInArrow(lambda batches: score(pool(batches)), schema)


def keep_good(docs: DataFrame, labels: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The given columns of the documents whose score reaches ``threshold``; no row is moved to be scored.

    Nulls, empty texts, repeated rows and empty tables as in ``score_quality``.  ``columns`` must not hold ``score``.
    """
    return scored_rows(docs, labels, columns).where(F.col("score") >= threshold).drop("score")
