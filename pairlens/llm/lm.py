"""Masked pseudo-likelihood: a window network predicts every word from both sides.

The network's output is a tree over a real vocabulary: the ``WORDS`` most frequent words and one
place for all others, told apart by 64-bit hashes.  The hidden layer of the two words on each side
chooses a branch, a twig of that branch and a word of that twig, each by a softmax of its own, so
every word depends on its context at about the price of three small softmaxes.  Words with like
neighbours lie on the same branch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .sums import BLOCKS, blocks, task_number, total
from .text import BLANK, LOWER, Words, chunks, mix, words

# The tree: branches, twigs on a branch, words on a twig, as many as twigs.  One place is that of unknown words.
BRANCHES, TWIGS, LEAVES = 64, 32, 32
NODES = BRANCHES * TWIGS
PLACES = NODES * LEAVES
WORDS = PLACES - 1
# Inputs: the KNOWN most frequent words each have a vector, the others share that of their twig; the last is "beyond the text".
KNOWN, DIM, HIDDEN = 2048, 8, 32
AROUND = (-2, -1, 1, 2)
INPUTS = KNOWN + NODES + 1
# Hidden units that the two lower softmaxes read, and the length of the vectors that neighbours are told by.
LOWER_UNITS, NEIGHBOUR = 12, 12
ROWS = 1 << 13
# Distinct words a task holds before it passes their counts on, and steps of the counts' logarithm.
HELD, STEPS = 1 << 20, 64
EMPTY = -30.0
# Bits of a hash that words are looked up by.
LEADING = 20
# Numbers up to here have exponentials that add up well, and the numbers of positions that a node's are filled up to.
LARGE = 60.0
TOGETHER = np.append([1, 2, 3, 4], np.outer(2 ** np.arange(1, 30), [3, 4]).ravel())


@dataclass
class Vocabulary:
    """Known words as sorted hashes, their places in the tree, and what the corpus counts say of each place.

    ``place`` and ``given`` (the input vector's number) have one entry more than ``hash``: that of unknown
    words.  ``log_spelling`` is an unknown word's log probability among them: they count as equally likely,
    and all that were never seen count as one.
    """

    hash: np.ndarray
    count: np.ndarray
    place: np.ndarray
    given: np.ndarray
    log_spelling: float
    leading: np.ndarray | None = None
    most: int = 0

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, unknown: tuple[int, int], near: np.ndarray) -> Vocabulary:
        """``counts`` of the sorted ``hashes``, distinct and all occurrences of other words, sums of neighbours' vectors."""
        count = np.append(counts, unknown[1]).astype(np.float64)
        # A smoothed mean, so that what few neighbours say of a rare word weighs little.
        mean = near / (count[:, None] + 8.0)
        twig = _twigs(mean, count)
        order = np.lexsort((-count, twig))
        begin = np.searchsorted(twig[order], np.arange(NODES))
        place = np.empty(len(count), dtype=np.int64)
        place[order] = twig[order] * LEAVES + np.arange(len(count)) - begin[twig[order]]
        given = KNOWN + twig
        often = np.lexsort((np.arange(len(count)), -count))[:KNOWN]
        given[often] = np.arange(len(often))
        return Vocabulary(hashes, count, place, given, -float(np.log(unknown[0] + 1.0)))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; that of unknown ones is ``len(hash)``."""
        if not len(self.hash):
            return np.zeros(len(hashes), dtype=np.int64)
        if self.leading is None:
            # Where the known words with the same leading bits begin; mostly there is one at most.
            n = np.bincount((self.hash >> np.uint64(64 - LEADING)).view(np.int64), minlength=1 << LEADING)
            self.leading, self.most = (np.cumsum(n) - n).astype(np.int32), int(n.max())
        at, unknown = self.leading.take((hashes >> np.uint64(64 - LEADING)).view(np.int64)), len(self.hash)
        np.minimum(at, unknown - 1, out=at)
        hit = self.hash.take(at) == hashes
        found = np.where(hit, at, unknown).astype(np.int64)
        # Few words are not the first known one with their leading bits.
        rest, at = np.flatnonzero(~hit), at[~hit]
        for _ in range(1, self.most):
            at = np.minimum(at + 1, unknown - 1)
            hit = self.hash.take(at) == hashes.take(rest)
            found[rest[hit]] = at[hit]
            rest, at = rest[~hit], at[~hit]
        return found


def _twigs(mean: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The twig of each word: groups are halved at the median of their widest direction until ``NODES`` are left."""
    twig, weight = np.zeros(len(mean), dtype=np.int64), np.sqrt(count + 1.0)
    groups = [np.arange(len(mean))]
    for _ in range(NODES.bit_length() - 1):
        halves = []
        for group in groups:
            x = mean[group]
            if len(group) > 2:
                x = x - np.average(x, axis=0, weights=weight[group])
                wide = np.linalg.eigh((x * weight[group, None]).T @ x)[1][:, -1]
                group = group[np.argsort(x @ (wide * np.sign(wide[np.argmax(np.abs(wide))])), kind="stable")]
            half = (len(group) + 1) // 2
            halves += [group[:half], group[half:]]
        groups = halves
    for i, group in enumerate(groups):
        twig[group] = i
    return twig


# Inputs, hidden layer, branches, then one matrix for the twigs of each branch and one for the words of each twig,
# whose last row are constants.
SHAPES = (
    (INPUTS, DIM), (len(AROUND) * DIM, HIDDEN), (HIDDEN,), (HIDDEN, BRANCHES), (BRANCHES,),
    (BRANCHES + NODES, LOWER_UNITS + 1, LEAVES),
)
SIZES = [int(np.prod(s)) for s in SHAPES]


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    return [p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(SIZES)[:-1]), SHAPES)]


def start_weights(vocabulary: Vocabulary) -> np.ndarray:
    """Weights by which every word has its share of the corpus, whatever stands around it."""
    rng = np.random.default_rng(11)
    share = np.zeros(PLACES)
    share[vocabulary.place] = vocabulary.count + 1.0
    constants = []
    for shape in ((BRANCHES, TWIGS * LEAVES), (NODES, LEAVES), (PLACES, 1)):
        mass = share.reshape(shape).sum(axis=1)
        constants.append(np.where(mass > 0, np.log(np.maximum(mass, 1.0)), EMPTY))
    # A softmax takes what its own group holds; places and nodes without a word keep a probability of nearly 0.
    by_branch, by_twig, by_word = constants[0], constants[1].reshape(BRANCHES, TWIGS), constants[2].reshape(NODES, LEAVES)
    centred = [c - np.maximum(c.max(axis=-1, keepdims=True), EMPTY) for c in (by_branch, by_twig, by_word)]
    parts = [rng.normal(0, 0.3, SHAPES[0]), rng.normal(0, 1 / np.sqrt(SHAPES[1][0]), SHAPES[1]), np.zeros(HIDDEN)]
    lower = np.zeros(SHAPES[5])
    lower[:, -1] = np.concatenate(centred[1:])
    parts += [np.zeros(SHAPES[3]), centred[0], lower]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def line_up(given: np.ndarray, doc: np.ndarray, beyond: int = INPUTS - 1) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one line with two places ``beyond`` the text around each, and where each position stands in it."""
    where = np.arange(len(given)) + 2 * (doc + 1)
    line = np.full(len(given) + 2 * (int(doc[-1]) + 2 if len(doc) else 2), beyond, dtype=np.int64)
    line[where] = given
    return line, where


def windows(line: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Input numbers around each place of the line; positions beyond its text have the last number."""
    return line.take(where[:, None] + np.array(AROUND))


def _shifted_exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(z - shift), in place, that shift and the sum of each row; rows need shifts of their own only where numbers are large."""
    shift = np.zeros(1, dtype=z.dtype)
    if z.size and (z.max() > LARGE or z.min() < -LARGE):
        shift = z.max(axis=1)
        z -= shift[:, None]
    np.exp(z, out=z)
    return z, shift, z @ np.ones(z.shape[1], dtype=z.dtype)


def _shares(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log of what the softmax of each row gives to the choice, whose number in ``z`` is ``chosen``; spoils ``z``."""
    picked = z.ravel().take(chosen)
    _, shift, total_ = _shifted_exp(z)
    return picked - (shift + np.log(total_)).take(chosen // z.shape[1])


def _lower(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two lower steps to each of the sorted places, one after the other: nodes (sorted), and what is chosen there."""
    _, twig, leaf = choices(place)
    return np.append(place // (TWIGS * LEAVES), BRANCHES + place // LEAVES), np.append(twig, leaf)


def _changes(node: np.ndarray) -> np.ndarray:
    """Where another node begins."""
    return np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])


def _units(h: np.ndarray) -> np.ndarray:
    """The hidden units that the two lower softmaxes read, with a 1."""
    out = np.ones((len(h), LOWER_UNITS + 1), dtype=h.dtype)
    out[:, :-1] = h[:, :LOWER_UNITS]
    return out


@dataclass
class Stacks:
    """The two lower steps to each of the sorted places, with those at one node next to each other.

    ``node`` has the nodes that are met, those with few positions first.  Nodes with 1, 2, 3, 4, 5 to 6,
    7 to 8 and so on positions are filled up to the same number of rows by rows of zeros, which move
    nothing, so a group of them is a stack of matrices and a batch costs a few products of stacks:
    ``groups`` has the nodes and the rows of each.  ``row`` is where a position's two steps stand,
    ``units`` the hidden units with a 1 in each row, and ``chosen`` the number of each step's choice.
    """

    node: np.ndarray
    groups: list[tuple[slice, slice]]
    row: np.ndarray
    units: np.ndarray
    chosen: np.ndarray

    @staticmethod
    def of(place: np.ndarray, h: np.ndarray) -> Stacks:
        node, chosen = _lower(place)
        begin = _changes(node)
        n = np.diff(np.append(begin, len(node)))
        wide = np.searchsorted(TOGETHER, n)
        few = np.argsort(wide.astype(np.uint8), kind="stable")
        size, groups, i, a = TOGETHER[wide[few]], [], 0, 0
        for k, many in enumerate(np.bincount(wide).tolist()):
            if many:
                j, b = i + many, a + many * int(TOGETHER[k])
                groups.append((slice(i, j), slice(a, b)))
                i, a = j, b
        first = np.empty_like(begin)
        first[few] = np.cumsum(size) - size
        row = np.repeat(first - begin, n) + np.arange(len(node))
        # The last entry is that of the rows of zeros.
        source = np.full(a, len(h))
        source[row] = np.tile(np.arange(len(h)), 2)
        units = np.append(_units(h), np.zeros((1, LOWER_UNITS + 1), dtype=h.dtype), axis=0).take(source, axis=0)
        return Stacks(node[begin[few]], groups, row, units, row * LEAVES + chosen)

    def each(self, *rows: np.ndarray) -> Iterator[tuple]:
        """For each group the numbers of its nodes, and its part of the arrays of rows as stacks of matrices."""
        for nodes, part in self.groups:
            yield nodes, *(r[part].reshape(nodes.stop - nodes.start, -1, r.shape[1]) for r in rows)

    def logits(self, w: np.ndarray) -> np.ndarray:
        """The numbers of each row's softmax, by the matrices of the nodes."""
        z = np.empty((len(self.units), LEAVES), dtype=w.dtype)
        for nodes, h, out in self.each(self.units, z):
            np.matmul(h, w[nodes], out=out)
        return z


def _hidden(weights: list[np.ndarray], given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs and the hidden layer."""
    x = weights[0].take(given, axis=0).reshape(len(given), -1)
    h = x @ weights[1]
    h += weights[2]
    return x, np.tanh(h, out=h)


def _top(weights: list[np.ndarray], h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the branches' softmax, and which of them are the choices."""
    z = h @ weights[3]
    z += weights[4]
    return z, np.arange(len(place)) * BRANCHES + choices(place)[0]


def path_log_probability(weights: list[np.ndarray], given: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The log probability of each place (sorted): the sum over the three choices on the way to it."""
    _, h = _hidden(weights, given)
    node, chosen = _lower(place)
    units, n = _units(h), len(h)
    z = np.empty((2 * n, LEAVES), dtype=h.dtype)
    # Sorted positions have many in a row at the same node.
    begin = _changes(node).tolist()
    for i, j, met in zip(begin, [*begin[1:], 2 * n], node[begin].tolist()):
        np.matmul(units[i % n : i % n + j - i], weights[5][met], out=z[i:j])
    lower = _shares(z, np.arange(2 * n) * LEAVES + chosen)
    return _shares(*_top(weights, h, place)) + lower[:n] + lower[n:]


def in_order(place: np.ndarray) -> np.ndarray:
    """The numbers of the positions by their places; numbers this short are sorted by digits."""
    return np.argsort(place.astype(np.min_scalar_type(PLACES - 1)), kind="stable")


def choices(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is chosen at each of the three steps to a place."""
    return place // (TWIGS * LEAVES), place // LEAVES % TWIGS, place % LEAVES


def _counts(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        table = lambda: pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(counts)], names=["word", "n"])
        for batch in batches:
            for part in chunks(batch, text):
                found, n = np.unique(words(part.column(text), BLANK, LOWER).hash, return_counts=True)
                known, back = np.unique(np.concatenate((known, found)), return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, n)), len(known)).astype(np.int64)
                if len(known) > HELD:
                    yield table()
                    known, counts = known[:0], counts[:0]
        yield table()

    return run


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (hash) and ``n`` of every word of all documents; each task adds up its own before the shuffle."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_counts("text"), "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Sorted hashes and counts of known words, and how many others there are, distinct ones and occurrences.

    Known are the words of the highest counts; those counts are grouped by their logarithm, and a
    group that does not fit into ``size`` stays out as a whole, so ties are not cut.
    """
    step = F.floor(F.log2("n") * STEPS)
    rows = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
    table = sorted(((r["step"], r["words"], r["n"]) for r in rows.collect()), reverse=True)  # at most 64 * STEPS rows
    least, room, unknown = 0, size, (0, 0)
    for i, (at, n_words, _) in enumerate(table):
        if n_words > room:
            least, unknown = at + 1, (sum(r[1] for r in table[i:]), sum(r[2] for r in table[i:]))
            break
        room -= n_words
    known = counts.where(step >= least).toArrow()  # at most ``size`` rows
    hashes, n = (known.column(c).to_numpy() for c in ("word", "n"))
    hashes = hashes.astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], n[order], unknown


def signs(hashes: np.ndarray) -> np.ndarray:
    """A vector of 1 and -1 for each word and one for unknown words."""
    bits = mix(np.append(hashes, np.uint64(0)) + np.uint64(0x9E3779B97F4A7C15))
    return np.where(bits[:, None] >> np.arange(NEIGHBOUR, dtype=np.uint64) & np.uint64(1), 1.0, -1.0).astype(np.float32)


def _neighbours(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, vectors = shared.value
        out = np.zeros((NEIGHBOUR, len(vectors)))
        # The vector of no word stands between two texts.
        padded = np.ascontiguousarray(np.append(vectors, np.zeros((1, NEIGHBOUR), dtype=np.float32), axis=0).T)
        for batch in batches:
            for part in chunks(batch, text):
                w = words(part.column(text), BLANK, LOWER)
                ids = vocabulary.ids(w.hash)
                line, where = line_up(ids, w.doc, len(vectors))
                for j in range(NEIGHBOUR):
                    v = padded[j].take(line)
                    out[j] += np.bincount(ids, (v[1:-3] + v[3:-1] + v[:-4] + v[4:]).take(where - 2), len(vectors))
        yield blocks(out.T, task_number())

    return run


def learn_vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Counts of all words of the corpus, the known ones, and a tree of them by their neighbours in all documents."""
    counts = materialize(word_counts(docs, text), "word-counts")
    hashes, n, unknown = frequent_words(counts)
    vectors = signs(hashes)
    # The neighbours that are everywhere tell words apart best when each counts by its rarity.
    vectors *= np.minimum(1.0, np.sqrt(0.001 * max(n.sum() + unknown[1], 1) / (np.append(n, unknown[1]) + 1.0)))[:, None].astype(np.float32)
    empty = Vocabulary(hashes, n, n, n, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((empty, vectors))
    near = total(docs.select(F.col(text).alias("text")).mapInArrow(_neighbours(shared, "text"), BLOCKS), vectors.size)
    return Vocabulary.of(hashes, n, unknown, near.reshape(vectors.shape).astype(np.float64))


def positions(w: Words, every: int, turn: int) -> np.ndarray:
    """One position in ``every``, by a hash of its word and place; the turns 0 to ``every - 1`` have each position once."""
    key = w.hash + np.arange(len(w.hash), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.flatnonzero(mix(key) % np.uint64(every) == np.uint64(turn % every))


def _train(shared, text: str, every: int, turn: int, batch_size: int, rate: float):
    """Local stochastic gradient steps over every document of a task; gives the weights times the windows seen, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        flat = flat.copy()
        weights, seen, memory = unpack(flat), 0, start_memory()
        for batch in batches:
            for part in chunks(batch, text):
                w = words(part.column(text), BLANK, LOWER)
                ids = vocabulary.ids(w.hash)
                at = positions(w, every, turn)
                at = np.random.default_rng(len(ids)).permutation(at)
                line, where = line_up(vocabulary.given[ids], w.doc)
                for i in range(0, len(at), batch_size):
                    rows = at[i : i + batch_size]
                    _step(weights, memory, windows(line, where[rows]), vocabulary.place[ids[rows]], rate)
                seen += len(at)
        yield blocks(np.append(flat * max(seen, 1e-6), max(seen, 1e-6)), task_number())

    return run


def start_memory() -> list[np.ndarray]:
    """Sums of squared gradients: one per weight at the top, one per choice in the two lower steps."""
    top = [np.full(s, 1e-4, dtype=np.float32) for s in SHAPES[:5]]
    return [*top, np.ones(SHAPES[5][::2], dtype=np.float32)]


def _errors(z: np.ndarray, chosen: np.ndarray) -> None:
    """What the softmax of each row gives the choices, less those made, whose numbers in ``z`` are ``chosen``; in place."""
    z *= (1.0 / _shifted_exp(z)[2])[:, None]
    z.reshape(-1)[chosen] -= 1.0


def _step(weights: list[np.ndarray], memory: list[np.ndarray], given: np.ndarray, place: np.ndarray, rate: float) -> None:
    """One Adagrad step on the cross-entropy of the three choices; the weights change in place."""
    order = in_order(place)
    given, place = given.take(order, axis=0), place.take(order)
    x, h = _hidden(weights, given)
    top, chosen = _top(weights, h, place)
    _errors(top, chosen)
    back = top @ weights[3].T
    back[:, :LOWER_UNITS] += _lower_step(weights[5], memory[5], Stacks.of(place, h), rate)
    one, share = np.ones(len(place), dtype=h.dtype), h.dtype.type(1 / len(place))
    ahead, bias = h.T @ top, one @ top
    h *= h
    np.subtract(1.0, h, out=h)
    h *= share
    back *= h
    # One row for each word around and dimension, as long as the batch.
    at = given.T[:, None] + np.arange(DIM)[:, None] * INPUTS
    embed = np.bincount(at.ravel(), (weights[1] @ back.T).ravel(), INPUTS * DIM).reshape(DIM, INPUTS).T.astype(np.float32, order="C")
    for w, m, g in zip(weights, memory, (embed, x.T @ back, one @ back, ahead * share, bias * share)):
        m += g * g
        g *= rate
        g /= np.sqrt(m)
        w -= g


def _lower_step(w: np.ndarray, memory: np.ndarray, stacks: Stacks, rate: float) -> np.ndarray:
    """The step of the nodes that the batch passes through, each by the sum over its own positions; gives what their errors say of the hidden units."""
    old = w.take(stacks.node, axis=0)
    error = stacks.logits(old)
    _errors(error, stacks.chosen)
    back, g = np.empty((len(error), LOWER_UNITS), dtype=w.dtype), np.empty_like(old)
    for nodes, h, e, out in stacks.each(stacks.units, error, back):
        np.matmul(e, old[nodes, :-1].transpose(0, 2, 1), out=out)
        if h.shape[1] == 1:
            np.multiply(h.transpose(0, 2, 1), e, out=g[nodes])
        else:
            np.matmul(h.transpose(0, 2, 1), e, out=g[nodes])
    m = memory.take(stacks.node, axis=0)
    m += g[:, -1] * g[:, -1]
    memory[stacks.node] = m
    g *= (rate / np.sqrt(m))[:, None, :]
    old -= g
    w[stacks.node] = old
    both = back.take(stacks.row, axis=0)
    n = len(both) // 2
    return both[:n] + both[n:]


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray


def fit(docs: DataFrame, text: str = "text", rounds: int = 2, every: int | None = None, batch_size: int = 2048, rate: float = 0.05) -> Model:
    """Train on all documents: words and their neighbours, then ``rounds`` of local training and averaging.

    In each round every task makes gradient steps over one position in ``every`` of all its
    texts, other ones in each round, and by default ``every`` is ``rounds``, so that each position
    of the corpus is trained on once; the tasks' weights are averaged by positions seen.  The
    work and what is gathered grow with the corpus; the model's size does not.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(text).alias("text"))
    vocabulary = learn_vocabulary(docs, text)
    every, flat = every or rounds, start_weights(vocabulary)
    for turn in range(rounds):
        shared = context.broadcast((vocabulary, flat))
        sums = total(rows.mapInArrow(_train(shared, "text", every, turn, batch_size, rate), BLOCKS), len(flat) + 1)
        if sums[-1] > 0:
            flat = (sums[:-1] / sums[-1]).astype(np.float32)
    return Model(vocabulary, flat)


def token_log_probability(model: Model, w: Words) -> np.ndarray:
    """log p of every word given the two words on each side."""
    v, weights = model.vocabulary, unpack(model.weights)
    ids = v.ids(w.hash)
    out = np.where(ids == len(v.hash), v.log_spelling, 0.0)
    place, (line, where) = v.place[ids], line_up(v.given[ids], w.doc)
    # Positions in the order of their places read each node's weights once.
    order = in_order(place)
    for i in range(0, len(ids), ROWS):
        at = order[i : i + ROWS]
        out[at] += path_log_probability(weights, windows(line, where[at]), place[at])
    return out


def _score(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                w = words(part.column(text), BLANK, LOWER)
                running = np.concatenate(([0.0], np.cumsum(token_log_probability(shared.value, w))))
                n, total_ = np.diff(w.first), running[w.first[1:]] - running[w.first[:-1]]
                mean = pa.array(total_ / np.maximum(n, 1), mask=n == 0)
                keep = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n.astype(np.int64)), pa.array(total_), mean], names=[*keep, "n_words", "log_likelihood", "mean_log_likelihood"])

    return run


def score_documents(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", model: Model | None = None) -> DataFrame:
    """``keep`` columns with ``n_words, log_likelihood, mean_log_likelihood`` of every document.

    The log-likelihood is the sum over all words of log p(word | two words on each side): the
    product of the network's three choices, and for a word outside the vocabulary the probability
    of an unknown word there times that of being this one.  Words are runs without ASCII white
    space, A-Z folded.  A null or empty text has no words, a sum of 0 and a null mean.  A very long
    text is scored whole, in pieces.  Repeated rows are each scored; no other column is read.  An
    empty corpus trains nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text))
    rows = docs.select(*keep, F.col(text).alias("_text"))
    more = [T.StructField("n_words", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())]
    return rows.mapInArrow(_score(shared, "_text"), T.StructType([*rows.schema.fields[:-1], *more]))
