import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import scaling
from pairlens.operators import imputation
from pairlens.operators.imputation import _binomial, em_impute

from conftest import as_dict, as_set


def phi(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def distance(xs):
    n, mu = len(xs), sum(xs) / len(xs)
    sd = math.sqrt(sum((x - mu) ** 2 for x in xs) / (n - 1))
    return max(abs(sum(y <= x for y in xs) / n - phi((x - mu) / sd)) for x in xs)


def test_normal_distance_and_scale_search(rows):
    rng = random.Random(4)
    xs = [math.sinh(rng.gauss(0, 3)) for _ in range(200)] + [0.0] * 10
    df = rows([(x,) for x in xs] + [(None,)], "x double")
    got = scaling.normal_distance(df, ["x"]).first()
    assert abs(got["distance"] - distance(xs)) < 1e-6
    losses = {k: round(distance([math.asinh(2.0**k * x) for x in xs]), 6) for k in range(-25, 26)}
    best = min(losses, key=lambda k: (losses[k], k))
    found = scaling.asinh_scale_search(df, ["x"]).first()
    assert (found["exponent"], found["distance"]) == (best, losses[best])


def test_constant_column_has_no_distance(rows):
    df = rows([(3.0,), (3.0,), (3.0,)], "x double")
    assert scaling.normal_distance(df, ["x"]).first()["distance"] is None
    assert scaling.asinh_scale_search(df, ["x"]).first()["distance"] is None


def test_last_all_zero_and_priors(rows):
    df = rows(
        [("a", y, x) for y, x in zip(range(1, 6), (0.0, 0.0, None, 3.0, 0.0))] + [("b", 1, 2.0), ("b", 2, 1.0)] + [("c", 1, None), ("c", 2, 0.0)],
        "u string, y int, x double",
    ).withColumn("id", F.concat_ws("_", "u", "y"))
    laz = scaling.last_all_zero(df, "u", "y", ["x"])
    assert as_dict(laz, "u", "x") == {"a": 2, "b": None, "c": 2}
    priors = scaling.zero_priors(df, laz, "id", "u", "y", ["x"])
    assert as_set(priors, "id", "name", "mu") == {("c_1", "x", 0.0)}
    sd = np.std([0, 0, 3, 0, 2, 1, 0], ddof=1)
    assert abs(priors.first()["sigma"] - sd) < 1e-12


def masked(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    cov = np.array([[1, 0.8, 0.3], [0.8, 1, 0.4], [0.3, 0.4, 1]])
    full = rng.multivariate_normal([10, 5, 1], cov, size=n)
    gap = rng.random((n, 3)) < 0.15
    pdf = pd.DataFrame(np.where(gap, np.nan, full), columns=list("abc"))
    pdf["id"], pdf["t"], pdf["u"] = range(n), np.arange(n) % 20, np.arange(n) // 20
    kind = np.where(full[:, 0] > 10, "hi", "lo").astype(object)
    pdf["k"] = np.where(rng.random(n) < 0.1, None, kind)
    df = spark.createDataFrame(pdf).select("id", "t", "u", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"], "k")
    return df, full, gap, kind


def test_imputation_recovers_the_distribution(spark):
    df, full, gap, kind = masked(spark)
    out = em_impute(df, "id", "t", "u", noms=["k"], bounds={"c": (0, None)}, m=3).toPandas()
    assert len(out) == 3 * len(full) and not out.isna().any().any()
    for _, one in out.groupby("imp"):
        one = one.sort_values("id")
        z = one[list("abc")].to_numpy()
        assert np.array_equal(z[~gap], full[~gap])
        assert np.abs(z.mean(0) - full.mean(0)).max() < 0.1
        assert abs(np.corrcoef(z[:, 0], z[:, 1])[0, 1] - 0.8) < 0.04
        assert z[:, 2][gap[:, 2]].min() >= 0
        # Imputed kinds follow the variable that decides them.
        assert (one["k"].to_numpy() == kind).mean() > 0.96
    draws = [g.sort_values("id")["a"].to_numpy()[gap[:, 0]] for _, g in out.groupby("imp")]
    assert not np.array_equal(draws[0], draws[1])


def test_imputation_is_the_same_on_any_partitioning_and_path(spark):
    df, *_ = masked(spark, 600)
    kw = dict(noms=["k"], m=2)
    base = em_impute(df.repartition(2), "id", "t", "u", **kw).toPandas().sort_values(["imp", "id"])
    other = em_impute(df.repartition(5), "id", "t", "u", **kw).toPandas().sort_values(["imp", "id"])
    assert np.allclose(base[list("abc")].to_numpy(), other[list("abc")].to_numpy())
    assert (base["k"].to_numpy() == other["k"].to_numpy()).all()


def test_priors_pull_missing_cells(spark):
    df, full, gap, _ = masked(spark, 1500)
    # Few cells: what the priors say also enters the estimated mean of the others.
    ids = np.nonzero(gap[:, 0])[0][:15]
    priors = spark.createDataFrame([(int(i), "a", 3.0, 0.01) for i in ids], "id bigint, name string, mu double, sigma double")
    out = em_impute(df.drop("k"), "id", "t", "u", priors=priors, m=1).toPandas().set_index("id")
    assert abs(out.loc[ids, "a"].mean() - 3.0) < 0.05
    rest = [i for i in np.nonzero(gap[:, 0])[0] if i not in set(ids)]
    assert abs(out.loc[rest, "a"].mean() - full[rest, 0].mean()) < 0.3


def test_unit_effects_and_ordinals(spark):
    rng = np.random.default_rng(1)
    n, units = 1200, 6
    u, t = np.arange(n) % units, (np.arange(n) // units) % 40
    x = u * 5.0 + 0.1 * t + rng.normal(0, 0.3, n)
    o = np.clip(np.round(u + rng.normal(0, 0.2, n)), 0, 5).astype(int)
    gx, go = rng.random(n) < 0.2, rng.random(n) < 0.2
    data = [(i, int(t[i]), int(u[i]), None if gx[i] else float(x[i]), None if go[i] else int(o[i])) for i in range(n)]
    df = spark.createDataFrame(data, "id bigint, t int, u int, x double, o int")
    with_units = em_impute(df, "id", "t", "u", ords=["o"], intercs=True, m=1, ridge=1.0).toPandas().sort_values("id")
    err = np.sqrt(np.mean((with_units["x"].to_numpy()[gx] - x[gx]) ** 2))
    assert err < 1.5
    assert set(with_units["o"]) <= set(range(6)) and with_units["o"].dtype.kind == "i"
    # Units cost no model columns; targets do.
    assert em_impute(df, "id", "t", "u", intercs=True, max_width=2, m=1).count() == n
    with pytest.raises(ValueError, match="model columns"):
        em_impute(df, "id", "t", "u", intercs=True, max_width=1)


def dense_fit(x, fixed, w, ridge, sweeps=4000, tol=1e-11):
    """EM with one covariance of targets and fixed columns, by its definition: coefficients and covariance of the targets given the rest."""
    n, t = len(x), x.shape[1]
    full = np.hstack([x, fixed])
    mu, sigma = np.zeros(full.shape[1]), np.eye(full.shape[1])
    groups = {}
    for i, gap in enumerate(np.isnan(x)):
        groups.setdefault(tuple(gap), []).append(i)
    total = w.sum()
    for _ in range(sweeps):
        filled, extra = np.nan_to_num(full), np.zeros_like(sigma)
        for gap, rows in groups.items():
            m = np.flatnonzero(gap)
            if not len(m):
                continue
            o = np.setdiff1d(np.arange(len(mu)), m)
            beta = np.linalg.lstsq(sigma[np.ix_(o, o)], sigma[np.ix_(o, m)], rcond=None)[0].T
            filled[np.ix_(rows, m)] = mu[m] + (full[np.ix_(rows, o)] - mu[o]) @ beta.T
            extra[np.ix_(m, m)] += w[rows].sum() * (sigma[np.ix_(m, m)] - beta @ sigma[np.ix_(o, m)])
        new_mu = w @ filled / total
        s = ((filled - new_mu).T * w) @ (filled - new_mu) / total + extra / total
        s = (total * s + ridge * np.diag(np.diag(s))) / (total + ridge)
        done = max(np.abs(new_mu - mu).max(), np.abs(s - sigma).max()) < tol
        mu, sigma = new_mu, s
        if done:
            break
    b = np.linalg.solve(sigma[t:, t:], sigma[t:, :t])
    return np.vstack([mu[:t] - mu[t:] @ b, b]), sigma[:t, :t] - sigma[:t, t:] @ b


def unit_panel(spark, units, periods, seed=4, gaps=0.2):
    rng = np.random.default_rng(seed)
    u, t = np.repeat(np.arange(units), periods), np.tile(np.arange(periods), units)
    level, slope = rng.normal(0, 3, units), rng.normal(0, 0.3, units)
    x = level[u] + slope[u] * t + rng.normal(0, 0.5, len(u))
    y = 0.7 * x + rng.normal(0, 0.5, len(u))
    gx, gy = rng.random(len(u)) < gaps, rng.random(len(u)) < gaps
    pdf = pd.DataFrame({"id": np.arange(len(u)), "t": t, "u": u, "x": np.where(gx, np.nan, x), "y": np.where(gy, np.nan, y)})
    df = spark.createDataFrame(pdf).select("id", "t", "u", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xy"])
    return df, pdf, x, gx


@pytest.mark.parametrize("intercs", [True, False])
def test_unit_blocks_equal_one_dense_covariance(spark, intercs):
    """20 units: the polynomial, and the covariance around it, as of one wide normal distribution."""
    df, pdf, _, _ = unit_panel(spark, 20, 12)
    cs = "u" if intercs else None
    lays = imputation._layouts(df, ["x", "y"], [], [], "t", cs, 2, intercs, 100, None)
    data = df.withColumn("__hash", F.xxhash64(F.lit(1), "id"))
    theta = imputation._em(imputation._sums(data, lays, 2, [], None, cs).cache(), lays, 2, 3.0, 1e-9, 3000)
    lay = lays[None]
    # createDataFrame turned the frame round: hashes come back by id.
    h = np.array([r["__hash"] for r in data.orderBy("id").collect()], dtype=np.int64).view(np.uint64)
    x, z = lay.matrix(pdf), lay.time(pdf)
    fixed = [z[:, 1:]]
    if intercs:
        fixed += [(pdf["u"].to_numpy() == k)[:, None] * z for k in range(1, 20)]
    for rep in range(2):
        b, sigma = dense_fit(x, np.hstack(fixed), imputation._bootstrap_weights(h, rep), 3.0)
        assert np.abs(theta[rep].b - b[:3]).max() < 1e-4 and np.abs(theta[rep].sigma - sigma).max() < 1e-4
    if intercs:
        effects = {r["__unit"]: {e["rep"]: e["b"] for e in r["__effects"]} for r in imputation._unit_table(imputation._sums(data, lays, 2, [], None, cs), theta, 2, "bigint").collect()}
        assert len(effects) == 19
        for k in (1, 7, 19):
            assert np.abs(np.array(effects[k][1]).reshape(3, 2) - b[3 + 3 * (k - 1) : 6 + 3 * (k - 1)]).max() < 1e-4


def test_two_thousand_units_and_one_with_a_single_period(spark):
    df, pdf, x, gx = unit_panel(spark, 2000, 12, seed=5)
    lone = spark.createDataFrame([(10**6, 3, 10**6, None, 1.0), (10**6 + 1, 3, 10**6 + 1, None, None)], df.schema)
    done = em_impute(df.unionByName(lone), "id", "t", "u", intercs=True, polytime=1, m=1).toPandas().set_index("id")
    plain = em_impute(df, "id", "t", "u", polytime=1, m=1).toPandas().set_index("id")
    assert len(done) == 24_002 and not done.isna().any().any()
    wrong = lambda out: np.sqrt(np.mean((out.loc[np.flatnonzero(gx), "x"].to_numpy() - x[gx]) ** 2))
    assert wrong(done) < 0.75 * wrong(plain)
    # Cubic trends of every unit converge as well.
    assert em_impute(df, "id", "t", "u", intercs=True, polytime=3, m=1).count() == 24_000


def test_many_different_priors_use_one_matrix_per_pattern(spark, monkeypatch):
    df, full, gap, _ = masked(spark, 3000)
    ids = np.nonzero(gap[:, 0])[0]
    rng = np.random.default_rng(2)
    told = full[ids, 0] + rng.normal(0, 0.05, len(ids))
    priors = spark.createDataFrame([(int(i), "a", float(v), float(0.05 + 0.001 * k)) for k, (i, v) in enumerate(zip(ids, told))], "id bigint, name string, mu double, sigma double")
    frame = df.drop("k")
    out = em_impute(frame, "id", "t", "u", priors=priors, m=1).toPandas().set_index("id")
    assert np.sqrt(np.mean((out.loc[ids, "a"].to_numpy() - full[ids, 0]) ** 2)) < 0.4
    # A precision that says nothing changes nothing.
    vague = em_impute(frame, "id", "t", "u", priors=priors.withColumn("sigma", F.lit(1e9)), m=1).toPandas().sort_values("id")
    none = em_impute(frame, "id", "t", "u", m=1).toPandas().sort_values("id")
    assert np.allclose(vague[list("abc")], none[list("abc")], atol=1e-5)
    calls = []
    whole = imputation._conditional
    monkeypatch.setattr(imputation, "_conditional", lambda *a: calls.append(1) or whole(*a))
    n = 100_000
    rng = np.random.default_rng(3)
    gaps = np.packbits(np.array([[True, False, False]]), axis=1)[0].tobytes()
    h, shift, cov = imputation._maps(gaps, np.eye(3) + 0.3, np.column_stack([rng.normal(size=n), np.zeros((n, 2))]), np.column_stack([rng.random(n), np.zeros((n, 2))]))
    assert len(calls) == 1 and h.shape == (n, 3, 3)


def test_prior_rows_by_the_definition():
    """Woodbury's update against the product of two normal densities."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(4, 4))
    sigma = a @ a.T + np.eye(4)
    gaps = np.packbits(np.array([[True, False, True, False]]), axis=1)[0].tobytes()
    m, o = [0, 2], [1, 3]
    centre, precision = np.array([[0.5, 0, -1.0, 0], [0.2, 0, 0, 0]]), np.array([[2.0, 0, 0.7, 0], [3.0, 0, 0, 0]])
    h, shift, cov = imputation._maps(gaps, sigma, centre, precision)
    y = rng.normal(size=4)
    beta = sigma[np.ix_(m, o)] @ np.linalg.inv(sigma[np.ix_(o, o)])
    plain = sigma[np.ix_(m, m)] - beta @ sigma[np.ix_(o, m)]
    for i in range(2):
        p = np.diag(precision[i, m])
        new = np.linalg.inv(np.linalg.inv(plain) + p)
        want = new @ (np.linalg.inv(plain) @ beta @ y[o] + p @ centre[i, m])
        # Around a mean of 0 the observed deviations are y itself and missing cells count as 0.
        got = (h[i] @ np.where(np.isin(np.arange(4), o), y, 0.0) + shift[i])[m]
        assert np.allclose(got, want, atol=1e-7) and np.allclose(cov[i][np.ix_(m, m)], new, atol=1e-7)


def test_replicates_share_the_scans_and_equal_the_serial_form(spark, monkeypatch):
    df, *_ = masked(spark, 500)
    copies = [df.select("id", "t", "u", (F.col("a") + F.lit(0.3 * k) * F.col("b")).alias("a"), "b", "c", "k").withColumn("copy", F.lit(k)) for k in (1, 2, 3)]
    both = copies[0].unionByName(copies[1]).unionByName(copies[2])
    scans = []
    once = imputation._expected_job
    monkeypatch.setattr(imputation, "_expected_job", lambda *a: scans.append(1) or once(*a))
    kw = dict(noms=["k"], m=2, bounds={"c": (0, None)})
    together = em_impute(both, "id", "t", "u", by="copy", **kw).toPandas().sort_values(["copy", "imp", "id"])
    shared, serial = len(scans), []
    for k, one in zip((1, 2, 3), copies):
        scans.clear()
        alone = em_impute(one.drop("copy"), "id", "t", "u", **kw).toPandas().sort_values(["imp", "id"])
        serial.append(len(scans))
        mine = together[together["copy"] == k]
        assert np.allclose(mine[list("abc")].to_numpy(), alone[list("abc")].to_numpy(), atol=1e-6)
        assert (mine["k"].to_numpy() == alone["k"].to_numpy()).all()
    assert shared == max(serial)


def test_levels_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(i, i % 5, f"level{i % 6}" if i % 7 else None, float(i)) for i in range(200)], "id int, t int, k string, x double")
    with pytest.raises(ValueError, match="levels"):
        em_impute(df, "id", "t", noms=["k"], polytime=0, max_width=4, m=1)


def test_an_unfinished_fit_is_not_returned(spark):
    df = spark.createDataFrame([(i, i % 5, float(i % 11) if i % 3 else None, float(i)) for i in range(200)], "id int, t int, y double, x double")
    with pytest.raises(RuntimeError, match="converge"):
        em_impute(df, "id", "t", m=1, max_iter=1)


def test_binomial_draws_follow_the_distribution_at_any_width():
    u = (np.arange(20_000) + 0.5) / 20_000
    for trials in (1, 7, 400, 100_000):
        for share in (0.0, 0.001, 0.3, 0.97, 1.0):
            got = _binomial(u, trials, np.full(len(u), share))
            assert got.min() >= 0 and got.max() <= trials and (np.diff(got) >= 0).all()
            sd = np.sqrt(trials * share * (1 - share))
            assert abs(got.mean() - trials * share) <= 0.02 * sd + 1e-9 and abs(got.std() - sd) <= 0.02 * sd + 0.02
