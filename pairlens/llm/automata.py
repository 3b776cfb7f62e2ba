"""Weighted acyclic automata that map word sequences to counts.

A count transducer holds, for every stored sequence and each of its beginnings, how often it
occurs.  It is built from sorted n-grams in one pass: states whose outgoing arcs agree in
labels, counts and targets are one state.  Transducers of shards are cut by ranges of
prefixes, those of one range are united by summing the weights of equal paths, and composing
one with a list of sequences looks up their counts.

While work goes on a transducer is spelled out as a ``Trie`` of sorted levels; ``pack`` makes
the minimal automaton of it, as bytes, and ``unpack`` spells it out again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .text import GRAM, mix


@dataclass
class Level:
    """Nodes of one depth, sorted by parent and label; ``parent`` is a place in the level above."""

    parent: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.label)


@dataclass
class Trie:
    """Level 0 holds the first labels.  ``texts`` spells out the labels of level 1, null where another range does."""

    levels: list[Level]
    texts: pa.Array = field(default_factory=lambda: pa.nulls(0, pa.binary()))

    @property
    def size(self) -> int:
        return sum(map(len, self.levels))


def gather(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``start[i], ..., start[i] + count[i] - 1`` of all i in turn."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def from_positions(chains: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, firsts: np.ndarray) -> list[Level]:
    """Levels of counts from places of a text.

    ``firsts`` are the labels of level 0.  ``chains[d]`` gives the places where a sequence of d + 1
    further labels begins, as (place in the chain before, number of the last label).
    """
    before, symbol = chains[0]
    levels = [Level(np.zeros(len(firsts), np.int64), firsts, np.bincount(before, minlength=len(firsts)))]
    width = max(len(labels), 1)
    node = None
    for at, symbol in chains:
        owner = at if node is None else node[at]
        keys, node, count = np.unique(owner * width + symbol, return_inverse=True, return_counts=True)
        levels.append(Level(keys // width, labels[keys % width], count))
    return levels


def from_paths(paths: dict[tuple[int, ...], int], depth: int) -> Trie:
    """A transducer of given sequences; beginnings that are not given weigh 0."""
    known = {p[:k] for p in paths for k in range(1, len(p) + 1)}
    levels, place = [], {(): 0}
    for d in range(1, depth + 1):
        mine = sorted(p for p in known if len(p) == d)
        levels.append(Level(
            np.array([place[p[:-1]] for p in mine], np.int64), np.array([p[-1] for p in mine], np.uint64), np.array([paths.get(p, 0) for p in mine], np.int64)
        ))
        place = {p: i for i, p in enumerate(mine)}
    return Trie(levels, pa.nulls(len(levels[1]) if depth > 1 else 0, pa.binary()))


def prefix_range(first: np.ndarray, second: np.ndarray | None, bits: int) -> np.ndarray:
    """The range of sequences that begin with ``first`` alone, or with ``first, second``: the top bits of a hash of that prefix."""
    key = mix(first) if second is None else mix(mix(first) * np.uint64(GRAM) + second)
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)


def cut(trie: Trie, bits: int) -> Iterator[tuple[int, Trie]]:
    """The parts of a transducer by prefix range, empty ones left out.

    Sequences of two and more words go by their first two, so that the continuations of a very
    common word are spread; a single word goes by itself, and weighs 0 where it only leads on.
    """
    words, pairs = trie.levels[1], trie.levels[2]
    home = prefix_range(words.label, None, bits)
    place = prefix_range(words.label[pairs.parent], pairs.label, bits)
    by_home, by_place = np.argsort(home, kind="stable"), np.argsort(place, kind="stable")
    edges = np.arange((1 << bits) + 1)
    home_at, place_at = np.searchsorted(home[by_home], edges), np.searchsorted(place[by_place], edges)
    child_at = [np.searchsorted(low.parent, np.arange(len(high) + 1)) for high, low in zip(trie.levels[2:], trie.levels[3:])]
    for r in range(1 << bits):
        own, two = by_home[home_at[r] : home_at[r + 1]], by_place[place_at[r] : place_at[r + 1]]
        if not len(own) and not len(two):
            continue
        one = np.union1d(own, pairs.parent[two])
        here = home[one] == r
        weight = np.where(here, words.weight[one], 0)
        zero, parent = np.unique(words.parent[one], return_inverse=True)
        levels = [
            Level(np.zeros(len(zero), np.int64), trie.levels[0].label[zero], np.bincount(parent, weight, len(zero)).astype(np.int64)),
            Level(parent, words.label[one], weight),
            Level(np.searchsorted(one, pairs.parent[two]), pairs.label[two], pairs.weight[two]),
        ]
        for start, low in zip(child_at, trie.levels[3:]):
            count = start[two + 1] - start[two]
            parent, two = np.repeat(np.arange(len(two)), count), gather(start[two], count)
            levels.append(Level(parent, low.label[two], low.weight[two]))
        texts = trie.texts.take(pa.array(one, mask=~here))
        yield r, Trie(levels, texts)


def union(tries: Sequence[Trie]) -> Trie:
    """One transducer with the sums of the weights of equal paths."""
    if len(tries) == 1:
        return tries[0]
    levels, moved = [], [np.zeros(1, np.int64)] * len(tries)
    texts = pa.concat_arrays([t.texts for t in tries])
    for d in range(len(tries[0].levels)):
        mine = [t.levels[d] for t in tries]
        parent = np.concatenate([to[x.parent] for to, x in zip(moved, mine)])
        label, weight = np.concatenate([x.label for x in mine]), np.concatenate([x.weight for x in mine])
        order = np.lexsort((label, parent))
        parent, label = parent[order], label[order]
        new = np.append(True, (parent[1:] != parent[:-1]) | (label[1:] != label[:-1]))[: len(label)]
        at = np.flatnonzero(new)
        levels.append(Level(parent[at], label[at], np.add.reduceat(weight[order], at) if len(at) else weight))
        to = np.empty(len(label), dtype=np.int64)
        to[order] = np.cumsum(new) - 1
        moved = np.split(to, np.cumsum([len(x) for x in mine])[:-1])
        if d == 1:
            texts = texts.take(pa.array(order[at]))
    return Trie(levels, texts)


def prune(trie: Trie, least: int) -> Trie:
    """Only paths of weight ``least`` or more, and what leads to them."""
    keep = [x.weight >= least for x in trie.levels]
    for d in range(len(keep) - 1, 0, -1):
        keep[d - 1][trie.levels[d].parent[keep[d]]] = True
    levels, renumber = [], np.zeros(1, np.int64)
    for x, k in zip(trie.levels, keep):
        levels.append(Level(renumber[x.parent[k]], x.label[k], x.weight[k]))
        renumber = np.cumsum(k) - 1
    return Trie(levels, trie.texts.filter(pa.array(keep[1])))


def compose(trie: Trie, paths: Sequence[np.ndarray], length: np.ndarray) -> np.ndarray:
    """Weights of sequences: ``paths[d]`` holds their labels at depth d, ``length`` how many count.  0 where a path is missing."""
    out = np.zeros(len(length), dtype=np.int64)
    at, node = np.arange(len(length)), np.zeros(len(length), dtype=np.int64)
    for d, level in enumerate(trie.levels):
        at, node = at[length[at] > d], node[length[at] > d]
        if not len(at) or not len(level):
            break
        labels = np.unique(level.label)
        keys = level.parent * len(labels) + np.searchsorted(labels, level.label)
        wanted = paths[d][at]
        number = np.minimum(np.searchsorted(labels, wanted), len(labels) - 1)
        found = np.minimum(np.searchsorted(keys, node * len(labels) + number), len(keys) - 1)
        hit = (level.parent[found] == node) & (level.label[found] == wanted)
        at, node = at[hit], found[hit]
        done = length[at] == d + 1
        out[at[done]] = level.weight[node[done]]
    return out


@dataclass
class States:
    """The states of one depth: ``first[s]`` to ``first[s + 1]`` are the arcs of state s."""

    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray


def minimal(trie: Trie) -> list[States]:
    """The states of the minimal automaton, by depth; the first depth has one, the root."""
    out, target = [], np.zeros(len(trie.levels[-1]), dtype=np.int64)
    for d in range(len(trie.levels) - 1, -1, -1):
        level = trie.levels[d]
        nodes = len(trie.levels[d - 1]) if d else 1
        first = np.searchsorted(level.parent, np.arange(nodes + 1))
        count = np.diff(first)
        arc = mix(level.label ^ mix(level.weight.astype(np.uint64) * np.uint64(GRAM) + target.astype(np.uint64)))
        running = np.append(np.uint64(0), np.cumsum(arc, dtype=np.uint64))
        sign = mix(running[first[1:]] - running[first[:-1]]) + count.astype(np.uint64)
        _, one, state = np.unique(sign, return_index=True, return_inverse=True)
        # Equal signs are checked arc by arc.
        like = one[state]
        same = count[like] == count
        if same.all():
            twin = gather(first[:-1][like], count)
            same = (level.label[twin] == level.label) & (level.weight[twin] == level.weight) & (target[twin] == target)
        if not same.all():
            one = state = np.arange(nodes)
        arcs = gather(first[:-1][one], count[one])
        out.append(States(np.append(0, np.cumsum(count[one])), level.label[arcs], level.weight[arcs], target[arcs]))
        target = state
    return out[::-1]


def spelled(states: Sequence[States]) -> list[Level]:
    levels, state = [], np.zeros(1, dtype=np.int64)
    for s in states:
        count = np.diff(s.first)[state]
        arcs = gather(s.first[:-1][state], count)
        levels.append(Level(np.repeat(np.arange(len(state)), count), s.label[arcs], s.weight[arcs]))
        state = s.target[arcs]
    return levels


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(trie: Trie, **head) -> bytes:
    """The minimal automaton as compressed bytes, with a few JSON values."""
    states = minimal(trie)
    labels, which = np.unique(np.concatenate([s.label for s in states]), return_inverse=True)
    parts = np.split(which, np.cumsum([len(s.label) for s in states])[:-1])
    arrays = [labels]
    for s, number in zip(states, parts):
        arrays += [_narrow(np.diff(s.first)), _narrow(number), _narrow(s.weight), _narrow(s.target)]
    spoken = np.array(trie.texts.is_valid(), dtype=np.uint8)
    texts = trie.texts.drop_null()
    arrays += [spoken, _narrow(np.asarray(pa.compute.binary_length(texts)).astype(np.int64)), np.frombuffer(b"".join(texts.to_pylist()), np.uint8)]
    head = json.dumps({**head, "arrays": [[x.dtype.str, len(x)] for x in arrays]}).encode()
    raw = b"".join([len(head).to_bytes(4, "little"), head, *(x.tobytes() for x in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[Trie, dict]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = int.from_bytes(raw[:4], "little")
    head, at, arrays = json.loads(raw[4 : 4 + size]), 4 + size, []
    for kind, n in head.pop("arrays"):
        arrays.append(np.frombuffer(raw, kind, n, at))
        at += arrays[-1].nbytes
    labels, *rest = arrays
    *rest, spoken, lengths, letters = rest
    states = []
    for i in range(0, len(rest), 4):
        count, number, weight, target = (x.astype(np.int64) for x in rest[i : i + 4])
        states.append(States(np.append(0, np.cumsum(count)), labels[number], weight, target))
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths, dtype=np.int64))), pa.py_buffer(letters)])
    place = np.cumsum(spoken.astype(np.int64)) - 1
    return Trie(spelled(states), texts.cast(pa.binary()).take(pa.array(place, mask=spoken == 0))), head
