"""Kernel densities, discrete boosting and adaptive splines against hand-written forms."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pairlens.operators import models as M
from pairlens.operators.adaboost import fit_stumps, margin, training_bound
from pairlens.operators.densities import kernel_grids
from pairlens.operators.splines import Hinge, hinge_columns, search_splines


def frame_of(spark, x, y, w=None):
    rows = [(i, float(y[i]), Vectors.dense(x[i]), *([float(w[i])] if w is not None else [])) for i in range(len(y))]
    return spark.createDataFrame(rows, ["row_id", "label", "features", *(["weight"] if w is not None else [])]).repartition(3)


def boosted(x, y, w, knots, rounds):
    """The textbook loop, with weights that sum to one."""
    w, f, out = w / w.sum(), np.zeros(len(y)), []
    for _ in range(rounds):
        best = (math.inf,)
        for j, ts in sorted(knots.items()):
            for sign in (1, -1):
                for t in ts:
                    error = w[np.where(x[:, j] > t, sign, -sign) != y].sum()
                    if error < best[0] - 1e-12:
                        best = (error, j, t, sign)
        error, j, t, sign = best
        if error >= 0.5 - 1e-9:
            break
        a = 0.5 * math.log((1 - error) / error)
        h = np.where(x[:, j] > t, sign, -sign)
        w = w * np.exp(-a * y * h)
        w, f = w / w.sum(), f + a * h
        out.append((j, t, sign, a))
    return out, f


def test_boosting_equals_a_hand_written_loop(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 3)), 2)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.4, 500) > 0.4, 1, -1)
    w = rng.integers(1, 4, 500).astype(float)
    frame = frame_of(spark, x, (y + 1) / 2, w)
    knots = M.feature_knots(frame, 9)
    stumps = fit_stumps(frame, knots, 23)
    want, f = boosted(x, y, w, knots, 23)
    assert [(s.feature, s.threshold, s.sign) for s in stumps] == [r[:3] for r in want]
    assert np.allclose([s.weight for s in stumps], [r[3] for r in want], atol=1e-9)
    got = frame.withColumn("x", M.vector_to_array("features")).select("row_id", margin(stumps, "x").alias("m")).orderBy("row_id").toPandas()["m"]
    assert np.allclose(got, f, atol=1e-9)
    bound = training_bound(stumps)
    assert all(b < a for a, b in zip(bound, bound[1:])) and w[np.sign(f) != y].sum() / w.sum() <= bound[-1] + 1e-9


def test_boosting_stops_early(spark):
    x = np.arange(40.0)[:, None]
    frame = frame_of(spark, x, x[:, 0] > 19.5)
    assert len(fit_stumps(frame, {0: [5.0, 19.5, 30.0]}, 10)) == 1
    noise = frame_of(spark, np.zeros((40, 1)), np.arange(40) % 2)
    assert fit_stumps(noise, {0: [0.5]}, 10) == []


def test_densities_equal_the_sum_over_all_values(spark):
    rng = np.random.default_rng(2)
    values = {("a", 0): rng.normal(3, 2, 400), ("a", 1): rng.exponential(1, 150), ("b", 0): np.full(30, 7.0), ("b", 1): np.array([1.0])}
    rows = [(k, j, float(v)) for (k, j), vs in values.items() for v in vs] + [("a", 0, None)]
    grids = kernel_grids(spark.createDataFrame(rows, "k string, j int, value double").repartition(4), ["k", "j"], points=400).collect()
    assert len(grids) == 4
    for g in grids:
        v = values[g["k"], g["j"]]
        x = g["low"] + g["step"] * np.arange(400)
        want = np.exp(-(((x[:, None] - v) / g["width"]) ** 2) / 2).sum(axis=1) / (len(v) * g["width"] * math.sqrt(2 * math.pi))
        assert np.abs(np.array(g["density"]) - want).max() < 0.01 * want.max()
        assert abs(sum(g["density"]) * g["step"] - 1) < 0.01
    iqr = np.subtract(*np.quantile(values["a", 0], [0.75, 0.25])) / 1.34
    width = next(g["width"] for g in grids if (g["k"], g["j"]) == ("a", 0))
    assert width == pytest.approx(0.9 * min(values["a", 0].std(ddof=1), iqr) * 400**-0.2)


def test_kernel_bayes_sees_what_moments_cannot(spark):
    """Two classes of equal mean and variance, one of them in two heaps."""
    rng = np.random.default_rng(3)
    y = np.arange(800) % 2
    x = np.where(y == 1, rng.choice([-1.0, 1.0], 800) * 3 + rng.normal(0, 0.3, 800), rng.normal(0, 3, 800))
    frame = frame_of(spark, x[:, None], y)
    kernel = M.fit_predict(frame, frame, "kernel_bayes").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    plain = M.fit_predict(frame, frame, "naive_bayes").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert kernel > plain + 0.15


def test_the_search_finds_planted_knots(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 100, size=(3000, 3))
    y = 2 * np.maximum(x[:, 0] - 40, 0) - np.maximum(25 - x[:, 1], 0) + rng.normal(0, 2, 3000)
    frame = frame_of(spark, x, y)
    knots = M.feature_knots(frame, 19)
    found = search_splines(frame, knots)
    used = {(h.feature, round(h.knot)) for h in found.hinges}
    assert {h.feature for h in found.hinges} == {0, 1}
    assert min(abs(k - 40) for f, k in used if f == 0) <= 5 and min(abs(k - 25) for f, k in used if f == 1) <= 5
    # The residual sum is that of a plain fit on the same columns.
    z = np.column_stack([np.ones(3000)] + [np.maximum(x[:, h.feature] - h.knot if h.up else h.knot - x[:, h.feature], 0) for h in found.hinges])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    assert found.residual == pytest.approx(((y - z @ b) ** 2).sum(), rel=1e-6) and np.allclose(found.coef, b, rtol=1e-4, atol=1e-4)
    assert found.residual < 1.15 * 4 * 3000
    made = hinge_columns(frame.select("row_id", "features"), found.hinges).orderBy("row_id").first()["features"]
    assert np.allclose(made, z[0, 1:])


def test_without_a_pattern_nothing_is_chosen(spark):
    rng = np.random.default_rng(5)
    frame = frame_of(spark, rng.normal(size=(500, 2)), np.full(500, 3.0))
    assert search_splines(frame, {0: [0.0], 1: [0.0]}).hinges == ()
    assert search_splines(frame.where("false"), {0: [0.0]}).rows == 0
    with pytest.raises(ValueError, match="candidate"):
        search_splines(frame, {0: list(range(1500))})
    assert Hinge(0, 1.0, True) != Hinge(0, 1.0, False)
