import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pairlens.llm import lm
from pairlens.llm.text import BLANK, LOWER, words


def grammar(seed, n):
    pick, out = random.Random(seed), []
    for _ in range(n):
        k = pick.randrange(12)
        out += [f"noun{k}", f"verb{(k * 5) % 12}", "the"]
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(grammar(i, 60))) for i in range(300)]
    return lm.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every=2)


def by_hand(model, texts):
    """The pseudo-log-likelihood word by word."""
    embed, a, b, c, d = lm.unpack(model.weights.astype(np.float64))
    v, out = model.vocabulary, []
    for text in texts:
        w = words(pa.array([text], pa.string()), BLANK, LOWER)
        ids, total = lm.slots(w), 0.0
        for i in range(len(ids)):
            near = [ids[i + s] if 0 <= i + s < len(ids) else None for s in lm.AROUND]
            x = np.concatenate([embed[lm.INPUTS - 1 if n is None else v.given[n]] for n in near])
            z = np.tanh(x @ a + b) @ c + d
            total += z[v.kind[ids[i]]] - math.log(np.exp(z).sum()) + v.log_share[ids[i]]
        out.append(total)
    return out


def test_scores_are_sums_of_conditional_log_probabilities(spark, model, odd, odd_rows):
    got = lm.score_documents(odd, ["doc_id", "text"], model=model).collect()
    assert len(got) == len(odd_rows)
    texts = [r["text"] for r in got if len(r["text"] or "") < 3000]
    want = dict(zip(texts, by_hand(model, texts)))
    for r in got:
        if not (r["text"] or "").split():
            assert (r["n_words"], r["log_likelihood"], r["mean_log_likelihood"]) == (0, 0.0, None)
        elif r["text"] in want:
            assert r["log_likelihood"] == pytest.approx(want[r["text"]], rel=1e-4)
            assert r["mean_log_likelihood"] == pytest.approx(r["log_likelihood"] / r["n_words"])


def test_unseen_sentences_of_the_language_score_above_shuffled_ones(model):
    real = grammar(10_000, 400)
    mixed = real[:]
    random.Random(1).shuffle(mixed)
    score = lambda ws: lm.token_log_probability(model, words(pa.array([" ".join(ws)]), BLANK, LOWER)).mean()
    assert score(real) > score(mixed) + 0.5


def test_probabilities_of_a_class_sum_to_one():
    v = lm.Vocabulary.of(np.random.default_rng(1).integers(0, 50, lm.SLOTS).astype(float))
    assert np.allclose(np.bincount(v.kind, np.exp(v.log_share), lm.CLASSES), 1.0)


def test_counts_cover_all_words(spark, odd, odd_rows, none):
    assert lm.corpus_counts(odd).sum() == sum(len((r[1] or "").split()) for r in odd_rows)
    assert lm.score_documents(none, ["doc_id"]).count() == 0


def test_by_default_every_position_is_trained_on_once(spark, monkeypatch):
    rows = [(i, " ".join(grammar(i, 50))) for i in range(4)]
    turns, train = [], lm._train
    monkeypatch.setattr(lm, "_train", lambda shared, text, every, turn, *rest: turns.append((every, turn)) or train(shared, text, every, turn, *rest))
    lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    w = words(pa.array([r[1] for r in rows]), BLANK, LOWER)
    trained = np.concatenate([lm.positions(w, *t) for t in turns])
    assert sorted(trained.tolist()) == list(range(len(w.hash)))
