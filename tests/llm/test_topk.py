import math
import random

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import topk
from pairlens.llm.topk import best_of, top_k

SCHEMA = "vec_id long, embedding array<double>, id string, vector string, slot string, score string"


def rows_of(vectors):
    return [(i, v, "a", "b", "c", "d") for i, v in vectors]


def brute(vectors, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in sorted(ok):
        if i % 50 == 0:
            asks.setdefault(i, v)
    out = set()
    for q, qv in asks.items():
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in ok if i != q and len(v) == len(qv))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_is_exact_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    pick = random.Random(3)
    vectors = [(i, [pick.choice([-0.5, 0.0, 0.25, 0.7]) for _ in range(3)]) for i in range(230)]
    vectors += [(i, [0.5, 0.5, 0.5]) for i in range(300, 360)]  # one very common vector
    vectors += [(400, None), (401, [1.0, None, 2.0]), (402, [float("nan"), 1.0, 1.0]), (403, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    vectors += [(450, [1.0, 2.0]), (451, [3.0, -2.0]), (500, []), (501, []), (550, [1e300, -1e300, 1.0]), (-50, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5)
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, k=5).collect()}
    assert got == brute(vectors, 5)


def test_repeated_rows_and_few_candidates(spark):
    vectors = [(0, [1.0]), (0, [1.0]), (7, [2.0]), (7, [2.0]), (9, [-1.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows_of(vectors), SCHEMA), F.col("vec_id") % 50 == 0, k=5).collect())
    assert got == [(0, 1, 7, 131072), (0, 2, 7, 131072), (0, 3, 9, -65536)]


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_partial_selection_takes_ties_from_the_left():
    scores = np.array([[1.0, 3.0, 3.0, 3.0, -np.inf], [-np.inf, 2.0, 2.0, 1.0, 5.0]])
    row, score, ids = best_of(scores, np.array([10, 20, 30, 40, 50]), 2)
    assert list(zip(row.tolist(), ids.tolist())) == [(0, 20), (0, 30), (1, 20), (1, 50)]
