import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pairlens.operators import batch_logit as B
from pairlens.operators import sampling as G
from pairlens.operators import validation as V
from pairlens.operators.scoring import auc, log_loss


@pytest.fixture(scope="module")
def data(spark):
    """1,200 rows with a rare outcome, coarse features (so that scores tie), and how often 6 samples drew each row."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1200, 3)), 1) * [1.0, 50.0, 0.01] + [0, 900, 0]
    p = 1 / (1 + np.exp(-(-2.5 + x[:, 0] + (x[:, 1] - 900) / 60)))
    y = (rng.random(1200) < p).astype(float)
    draws = rng.poisson(1.0, size=(1200, 6))
    rows = [
        (i, float(y[i]), Vectors.dense(x[i]), [(s, float(c)) for s, c in enumerate(draws[i]) if c], int(draws[i, 0]) + 1) for i in range(1200)
    ]
    schema = "row_id int, label double, features struct<x:int>, draws array<struct<sample:int,count:double>>, heavy int"
    frame = spark.createDataFrame([(r[0], r[1], list(map(float, r[2])), r[3], r[4]) for r in rows], schema.replace("struct<x:int>", "array<double>"))
    return frame.repartition(5).cache(), x, y, draws


def reference_fit(spark, x, y, w, alpha=0.0, lam=0.0):
    """One fit on rows repeated as often as they count."""
    df = spark.createDataFrame([(float(y[i]), Vectors.dense(x[i])) for i in range(len(y)) for _ in range(w[i])], ["label", "features"])
    model = LogisticRegression(maxIter=500, tol=1e-13, elasticNetParam=alpha, regParam=lam).fit(df)
    return np.append(model.coefficients.toArray(), model.intercept)


def test_samples_equal_single_fits(spark, data):
    frame, x, y, draws = data
    fits = B.fit_logits(B.prepared(frame, "draws"), 6)
    assert fits.converged.all() and fits.scans <= 12
    for s in (0, 3, 5):
        want = reference_fit(spark, x, y, draws[:, s])
        got = np.append(fits.coef[s], fits.intercept[s])
        assert np.abs(got - want).max() < 1e-6 * max(1.0, np.abs(want).max())


def test_penalties_equal_single_fits(spark, data):
    frame, x, y, draws = data
    penalties = [(0.0, 0.01), (1.0, 0.01), (0.4, 0.05), (1.0, 10.0)]
    fits = B.fit_logits(B.prepared(frame, "draws"), 6, penalties)
    assert fits.coef.shape == (24, 3) and fits.converged.all()
    for s, i in ((1, 0), (2, 1), (4, 2)):
        want = reference_fit(spark, x, y, draws[:, s], *penalties[i])
        got = np.append(fits.coef[s * 4 + i], fits.intercept[s * 4 + i])
        assert np.abs((got - want) * [1, 50, 0.01, 1]).max() < 1e-5
    # Beyond some penalty only the base rate is left.
    last = fits.coef[3::4]
    assert (last == 0).all()


def test_row_weights_count_as_repeated_rows(spark, data):
    frame, x, y, draws = data
    weighted = B.fit_logits(B.prepared(frame, weight="heavy"))
    want = reference_fit(spark, x, y, draws[:, 0] + 1)
    assert np.abs(np.append(weighted.coef[0], weighted.intercept[0]) - want).max() < 1e-6 * np.abs(want).max()


def test_samples_without_a_best_fit(spark):
    rows = [(0.0, [float(i), 1.0], [(0, 1.0), (1, 1.0)]) for i in range(5)] + [(1.0, [float(i), 1.0], [(0, 1.0)]) for i in range(5, 10)]
    frame = spark.createDataFrame(rows, "label double, features array<double>, draws array<struct<sample:int,count:double>>")
    fits = B.fit_logits(B.prepared(frame, "draws"), 3, max_scans=20)
    # Separated: ever steeper, the constant column unused.  One class: its rate.  No rows: nothing.
    assert list(fits.converged) == [False, True, True] and fits.scans == 20
    assert fits.coef[0, 0] > 3 and (fits.coef[:, 1] == 0).all() and (fits.coef[1:] == 0).all() and fits.intercept[1] < -20
    with pytest.raises(ValueError):
        B.fit_logits(B.prepared(frame.where("false"), "draws"), 3)


def test_scores_equal_those_of_each_fit(spark, data, monkeypatch):
    frame, x, y, draws = data
    fits = B.fit_logits(B.prepared(frame, "draws"), 6)
    held = B.prepared(frame)
    want = []
    for c, i in zip(fits.coef, fits.intercept):
        scored = B.scored_by(held, c, i)
        want.append((log_loss(scored, "label", "p").first()[0], auc(scored, "label", "p").first()[0]))
    # All fits at once, fits in groups, and fit by fit where the positives are too many.
    for limit in (1 << 20, int(y.sum()) * 8 * 2, 8):
        monkeypatch.setattr(B, "POSITIVE_BYTES", limit)
        got = B.score_fits(held, fits)
        assert np.abs(np.array(got) - np.array(want)).max() < 1e-9
    one = B.score_fits(held.where("label = 1"), fits)
    assert all(a is None and loss > 0 for loss, a in one)
    flat = B.Fits(np.zeros((1, 3)), np.zeros(1), np.ones(1, bool), 0)
    assert B.score_fits(held, flat)[0] == pytest.approx((np.log(2), 0.5))


def test_ties_count_half(spark):
    frame = spark.createDataFrame([(1.0, [1.0]), (1.0, [2.0]), (0.0, [1.0]), (0.0, [0.0]), (0.0, [2.0])], "label double, features array<double>")
    fits = B.Fits(np.array([[1.0], [-1.0]]), np.zeros(2), np.ones(2, bool), 0)
    got = [a for _, a in B.score_fits(B.prepared(frame), fits)]
    scored = B.scored_by(B.prepared(frame), [1.0], 0.0)
    assert got[0] == auc(scored, "label", "p").first()[0] == 4 / 6 and got[1] == pytest.approx(1 - 4 / 6)


def test_block_draws_hold_every_draw_once():
    draws = np.array([0, 1, 9_999, 30_000, 2_000_000])
    size = 2 * G.DRAW_BLOCK + 900
    parts = [G.block_draws(draws, size, b, "7:1.0") for b in (2, 0, 1)]
    counts = np.concatenate([parts[1], parts[2], parts[0]], axis=1)
    assert counts.shape == (5, size) and (counts.sum(axis=1) == draws).all()
    assert (G.block_draws(draws, size, 1, "7:1.0") == parts[2]).all() and (G.block_draws(draws, size, 1, "8:1.0") != parts[2]).any()
    # Every row is drawn as often as any other, up to chance.
    for f in (3, 4):
        even = draws[f] / size
        assert abs(counts[f].var() / even - 1) < 0.1
        assert abs(parts[0][f].mean() / even - 1) < 6 / np.sqrt(900 * even)


def test_packed_counts_equal_lists(spark, data):
    frame, x, y, draws = data
    small, large = B.packed_counts(draws), B.packed_counts(draws * 300)
    mixed = pa.concat_arrays([small, large])
    assert (B.unpacked_counts(mixed, 6) == np.concatenate((draws, draws * 300))).all()
    assert (B.unpacked_counts(mixed.slice(1199, 2), 6) == [draws[-1], draws[0] * 300]).all()


def test_the_curve_makes_no_row_for_a_draw(spark, data, monkeypatch):
    frame = data[0].select("row_id", "label", "features")
    written = []
    monkeypatch.setattr(V, "materialize", lambda df, label, rebalance=False: written.append((label, df)) or df.cache())
    curve = V.downsample_curve(frame, frame, ratios=(1, 3), reps=2).collect()
    assert len(curve) == 6 and all(0 < r["log_loss"] < 5 and 0.5 < r["auc"] <= 1 for r in curve)
    rows = dict(written)["bootstraps"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and rows.count() <= frame.count()
    counts = np.stack([np.frombuffer(r["drawn"], np.uint8) for r in rows.collect()])
    positives = int(data[2].sum())
    assert counts.sum(axis=0).tolist()[:4] == [2 * positives] * 2 + [4 * positives] * 2
