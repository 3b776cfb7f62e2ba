import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from pairlens.llm import quality as Q
from pairlens.llm.quality import fit_network, keep_good, score_quality
from pairlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()


def test_held_out_documents_are_told_apart(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op5_quality"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(labels[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    y, s = np.array(held).T
    # The score has no inputs but the pooled vectors.
    assert auc(y, s) > 0.98


def test_vectors_pooling_and_score_against_brute_force(spark):
    """Contexts, pooling and the forward pass token by token."""
    pick = random.Random(4)
    texts = [" ".join(pick.choice(["One", "two", "three!!", "x", "y;", "é"]) for _ in range(pick.randint(0, 14))) for _ in range(40)] + [None, "!!", "solo"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    cut = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+", t or "")
    slots = {}
    for t in texts:
        if t:
            slots.update(zip(cut(t), Q.tokens(pa.array([t]))[0].tolist()))
    assert len(slots) == len(set(slots.values()))  # these few words do not collide
    place, sign = Q.index_vectors()
    index = lambda s: np.bincount(place[s], sign[s], Q.DIM)
    sums = {s: np.zeros(Q.DIM) for s in slots.values()}
    for t in texts:
        ids = [slots[x] for x in cut(t)]
        for i, s in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    sums[s] += index(ids[j])
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    want = {s: unit(unit(v) + index(s) / np.sqrt(Q.NONZERO)) for s, v in sums.items()}
    vectors = Q.word_vectors(frame)
    assert all(np.allclose(vectors[s], v, atol=1e-5) for s, v in want.items())

    net = Q.fit_network(np.random.default_rng(1).normal(size=(300, Q.WIDTH)), (np.arange(300) % 3 == 0).astype(float))
    shared = spark.sparkContext.broadcast(vectors)
    got = {r["doc_id"]: r["x"] for r in Q.pooled_features(frame, ["doc_id"], shared).collect()}
    for i, t in enumerate(texts):
        v = np.array([want[slots[x]] for x in cut(t)]).reshape(-1, Q.DIM)
        x = np.zeros(Q.WIDTH)
        if len(v):
            x[: Q.DIM] = v.mean(axis=0)
            x[Q.DIM :] = [np.mean([v[k] @ v[k + g] for k in range(len(v) - g)]) if len(v) > g else 0.0 for g in Q.APART]
        assert np.allclose(got[i], x, atol=1e-4)
        a, b, c, d = net.weights
        logit = sum(np.tanh(sum((x[k] - net.mean[k]) / net.scale[k] * a[k, h] for k in range(Q.WIDTH)) + b[h]) * c[h] for h in range(len(b))) + d
        assert net.probability(x[None])[0] == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)), abs=1e-6)


def test_odd_rows_and_labels(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (999, 0), (9, 0)], "doc_id long, quality int")
    got = score_quality(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(r["score"] is not None for r in got)
    same = [r["score"] for r in got if r["doc_id"] in (5, 6)]
    assert same[0] == pytest.approx(same[1])  # null counts as empty
    assert score_quality(none, labels).count() == 0
    assert {r["score"] for r in score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert keep_good(odd, labels, ["doc_id", "text", "key"], threshold=0.0).count() == len(odd_rows)


def test_temperature_makes_probabilities_match():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-x[:, 0] * 1.5))).astype(float)
    net = fit_network(x, y)
    p = net.probability(x)
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.0)):
        mine = (p >= low) & (p < high)
        assert abs(p[mine].mean() - y[mine].mean()) < 0.08


def test_labels_of_the_held_out_third_change_nothing(spark):
    pick = random.Random(1)
    docs = [(i, ("GOOD words here " if i % 2 else "bad%% words$$ ") * pick.randint(1, 9)) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = lambda i: crc32(str(i).encode()) % 3 == 1
    one = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    two = spark.createDataFrame([(i, 1 - i % 2 if held(i) else i % 2) for i, _ in docs], "doc_id long, quality int")
    score = lambda labels: {r["doc_id"]: r["score"] for r in score_quality(df, labels).collect()}
    a, b = score(one), score(two)
    assert all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a)
    assert all((a[i] >= 0.5) == (i % 2 == 1) for i in a)
