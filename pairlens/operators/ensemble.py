"""Ensemble weights on the simplex.

The weights sum to one, so with q = p for an event and q = 1 - p otherwise the loss of
the weighted mean is the mean of -log(w.q + eps): convex in w.  One pass over the
predictions gives value, gradient and curvature at the current weights, and the small
quadratic problem is solved on the driver.  A handful of passes replaces the hundreds
that fixed-point updates need.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .scoring import EPS, auc, blend, confusion, prediction_matrix, row_weight

STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)


def _likelihood_columns(preds: DataFrame, models: Sequence[str], y: str, row_id: str, weight: str | None = None) -> DataFrame:
    """Columns q0, q1 ... of the rows that every model scored, and their weight ``w``."""
    wide = prediction_matrix(preds, models, row_id, [y, *([weight] if weight else [])])
    qs = [F.when(F.col(y) == 1, F.col(f"`{m}`")).otherwise(1.0 - F.col(f"`{m}`")).alias(f"q{i}") for i, m in enumerate(models)]
    return wide.select(*qs, row_weight(weight).alias("w")).na.drop()


def _project(v: np.ndarray) -> np.ndarray:
    """Nearest point of the simplex."""
    s = np.sort(v)[::-1]
    c = (np.cumsum(s) - 1) / np.arange(1, len(v) + 1)
    k = np.nonzero(s > c)[0][-1]
    return np.maximum(v - c[k], 0)


def _quadratic_step(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Minimiser of the local quadratic model over the simplex (accelerated projected gradient)."""
    h = h + 1e-10 * np.trace(h) / len(w) * np.eye(len(w))
    lip = np.linalg.eigvalsh(h)[-1] + 1e-12
    x = z = w.copy()
    t = 1.0
    for _ in range(2000):
        new = _project(z - (g + h @ (z - w)) / lip)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max() < 1e-13:
            x = new
            break
        x, t = new, t_new
    return x


def _mix(w: np.ndarray):
    total = F.lit(EPS)
    for i, wi in enumerate(w):
        total = total + F.lit(float(wi)) * F.col(f"q{i}")
    return total


def fit_weights(q: DataFrame, k: int, tol: float = 1e-9, max_iter: int = 50) -> tuple[np.ndarray, float]:
    """Weights minimising the (row-weighted) mean of -log(w.q + eps) for the columns q0..q(k-1).

    Raises if the loss still falls after ``max_iter`` passes.
    """
    each = F.col("w") if "w" in q.columns else F.lit(1.0)
    rows = q.agg(F.sum(each)).first()[0]
    mean = lambda c: F.sum(each * c) / F.lit(float(rows or 1.0))
    w = np.full(k, 1.0 / k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    loss = np.inf
    for _ in range(max_iter):
        mix = F.col("mix")
        aggs = [mean(-F.ln(mix))] + [mean(F.col(f"q{i}") / mix) for i in range(k)]
        aggs += [mean(F.col(f"q{i}") * F.col(f"q{j}") / (mix * mix)) for i, j in pairs]
        row = q.withColumn("mix", _mix(w)).agg(*aggs).first()
        loss, g = row[0], -np.array(row[1 : k + 1])
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k + 1 :]):
            h[i, j] = h[j, i] = v
        # Largest possible decrease of the linear model over the simplex bounds the remaining loss.
        if float(g @ w - g.min()) <= tol * max(1.0, abs(loss)):
            break
        newton = _quadratic_step(w, g, h)
        update = w * -g
        update = update / update.sum()
        tries = [w + s * (newton - w) for s in STEPS] + [update]
        losses = list(q.agg(*[mean(-F.ln(_mix(c))) for c in tries]).first())
        best = int(np.argmin(losses))
        gain = loss - losses[best]
        if gain <= 0:
            break
        w, loss = np.maximum(tries[best], 0), losses[best]
        w = w / w.sum()
        if gain <= tol * max(1.0, abs(loss)):
            break
    else:
        raise RuntimeError(f"ensemble weights did not converge within {max_iter} passes")
    return w, float(loss)


def ensemble_weights(
    preds: DataFrame, models: Sequence[str], y: str = "label", row_id: str = "row_id", tol: float = 1e-9, max_iter: int = 50
) -> dict[str, float]:
    """Weights >= 0 with sum 1 that minimise the log-loss of the weighted mean probability.

    Fitted on the rows that every model scored; a ``weight`` column of ``preds`` weighs them.
    """
    q = _likelihood_columns(preds, models, y, row_id, "weight" if "weight" in preds.columns else None).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        w, _ = fit_weights(q, len(models), tol, max_iter)
    finally:
        q.unpersist()
    return dict(zip(models, w.tolist()))


def ablate(
    preds: DataFrame, models: Sequence[str], drop_models: Sequence[str], y: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """Weights re-fitted without the given models, and the score of that ensemble."""
    kept = [m for m in models if m not in set(drop_models)]
    weights = ensemble_weights(preds, kept, y, row_id)
    weight = "weight" if "weight" in preds.columns else None
    mixed = blend(preds, weights, row_id, [y, *([weight] if weight else [])], "ensemble")
    # One model, so one row: the area is a number beside it and needs no join.
    scored = confusion(mixed, y, "p", [], weight=weight).withColumn("auc", auc(mixed, y, "p", [], weight).scalar())
    return scored.select(F.lit("ensemble").alias("model"), "*", F.lit(",".join(drop_models)).alias("dropped"))
