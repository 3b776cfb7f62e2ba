"""The stacked steps of the language model against the same steps position by position."""

import numpy as np
import pyarrow as pa
import pytest

from pairlens.llm import lm
from pairlens.llm.text import BLANK, LOWER, words


def plain_logits(weights, given, place):
    embed, a, b, c, d, lower = (w.astype(np.float64) for w in weights)
    h = np.tanh(embed[given].ravel() @ a + b)
    low = np.append(h[: lm.LOWER_UNITS], 1.0)
    nodes = (place // (lm.TWIGS * lm.LEAVES), lm.BRANCHES + place // lm.LEAVES)
    return (h @ c + d, low @ lower[nodes[0]], low @ lower[nodes[1]]), low, nodes


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


@pytest.fixture
def model():
    rng = np.random.default_rng(3)
    weights = [rng.normal(0, 0.4, s).astype(np.float32) for s in lm.SHAPES]
    # Groups of 1, 2, 3, 7 and many positions on a node, and numbers far apart.
    place = np.repeat(rng.integers(0, lm.PLACES, 9), [1, 1, 1, 2, 2, 3, 7, 20, 70])
    weights[5][lm.BRANCHES + place[0] // lm.LEAVES, -1] -= np.linspace(0, 500, lm.LEAVES)
    return weights, rng.integers(0, lm.INPUTS, (len(place), len(lm.AROUND))), place


def test_log_probabilities_equal_the_product_of_the_three_choices(model):
    weights, given, place = model
    order = np.argsort(place, kind="stable")
    got = lm.path_log_probability(weights, given[order], place[order])
    for p, g, at in zip(got, given[order], place[order]):
        steps = zip(plain_logits(weights, g, at)[0], (at // 1024, at // 32 % 32, at % 32))
        assert p == pytest.approx(sum(z[k] - z.max() - np.log(np.exp(z - z.max()).sum()) for z, k in steps), rel=1e-4)


def test_one_step_sums_the_errors_of_each_node(model):
    weights, given, place = model
    want, own = weights[5].astype(np.float64), np.zeros((len(weights[5]), lm.LOWER_UNITS + 1, lm.LEAVES))
    for g, at in zip(given, place):
        logits, low, nodes = plain_logits(weights, g, at)
        for z, node, chosen in zip(logits[1:], nodes, (at // 32 % 32, at % 32)):
            own[node] += low[:, None] * (softmax(z) - (np.arange(32) == chosen))
    memory = lm.start_memory()
    want -= own * (0.05 / np.sqrt(memory[5] + own[:, -1] ** 2))[:, None, :]
    lm._step(weights, memory, given, place, 0.05)
    assert np.allclose(weights[5], want, rtol=1e-3, atol=1e-5)


def test_windows_stop_at_the_ends_of_a_text():
    w = words(pa.array(["a b c", "", "d"]), BLANK, LOWER)
    line, where = lm.line_up(np.array([10, 11, 12, 13]), w.doc)
    out = lm.INPUTS - 1
    assert lm.windows(line, where).tolist() == [[out, out, 11, 12], [out, 10, 12, out], [10, 11, out, out], [out] * 4]


def test_known_words_are_found_among_equal_leading_bits():
    hashes = np.sort(np.array([5, 6, 7, 1 << 50, (1 << 50) + 1, (1 << 64) - 1], dtype=np.uint64))
    v = lm.Vocabulary(hashes, hashes, hashes, hashes, 0.0)
    asked = np.append(hashes, np.array([0, 8, 1 << 51], dtype=np.uint64))
    assert v.ids(asked).tolist() == [0, 1, 2, 3, 4, 5, 6, 6, 6]


def test_a_step_fills_up_few_rows(model, monkeypatch):
    """Nodes with five positions each, on the branches and on the twigs."""
    weights, rows = model[0], []
    place = np.repeat(np.arange(lm.BRANCHES) * lm.TWIGS * lm.LEAVES, 5)
    shifted = lm._shifted_exp
    monkeypatch.setattr(lm, "_shifted_exp", lambda z: rows.append(len(z)) or shifted(z))
    lm._step(weights, lm.start_memory(), np.zeros((len(place), len(lm.AROUND)), dtype=np.int64), place, 0.05)
    assert sum(rows) <= (1 + 2 * 4 / 3) * len(place)


def test_sums_over_neighbours_equal_those_word_by_word():
    class shared:
        pass

    texts = ["a b c a", None, "d", "b new a b"]
    hashes = np.sort(words(pa.array(["a b c d"]), BLANK, LOWER).hash)
    vectors = lm.signs(hashes)
    shared.value = (lm.Vocabulary(hashes, hashes, hashes, hashes, 0.0), vectors)
    (got,) = lm._neighbours(shared, "text")(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    want = np.zeros(vectors.shape)
    for text in texts:
        at = np.minimum(np.searchsorted(hashes, own := words(pa.array([text], pa.string()), BLANK, LOWER).hash), len(hashes) - 1)
        ids = np.where(hashes[at] == own, at, len(hashes))
        for i, word in enumerate(ids):
            want[word] += sum(vectors[ids[i + s]] for s in lm.AROUND if 0 <= i + s < len(ids))
    sums = np.concatenate([np.frombuffer(b, np.float32) for b in got.column("data").to_pylist()])
    assert np.allclose(sums[: want.size].reshape(want.shape), want)
