"""Adaptive splines: hinge pairs whose knots the data choose (Friedman, 1991, additive form).

One scan sums the products of all candidate hinges, the constant and the outcome.  Forward
selection and backward pruning by generalised cross-validation then need these sums only, so the
search costs one pass whatever the number of steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import matrix, task_sums

#: Candidate columns whose products are summed; more are refused, since the sums are their square.
MAX_COLUMNS, ROWS_AT_ONCE = 2000, 4096


@dataclass(frozen=True)
class Hinge:
    """``max(0, x - knot)`` if ``up``, else ``max(0, knot - x)``."""

    feature: int
    knot: float
    up: bool


@dataclass(frozen=True)
class Splines:
    """The chosen hinges with the coefficients of the linear fit, the constant first, and its residual sum."""

    hinges: tuple[Hinge, ...]
    coef: tuple[float, ...]
    residual: float
    rows: float


def _columns(x: np.ndarray, hinges: Sequence[Hinge]) -> np.ndarray:
    f = np.array([h.feature for h in hinges], dtype=int)
    z = (x[:, f] - np.array([h.knot for h in hinges])) * np.array([1.0 if h.up else -1.0 for h in hinges])
    return np.maximum(z, 0.0)


def _products(train: DataFrame, hinges: Sequence[Hinge], label: str) -> np.ndarray:
    """Weighted cross-products of (1, hinges, outcome)."""
    q = len(hinges) + 2
    low, high = np.triu_indices(q)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            y, w = (part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("y", "w"))
            v = np.hstack([np.ones_like(y), _columns(matrix(part.column("x")), hinges), y])
            total += ((v * w).T @ v)[low, high]

    kind = train.schema["features"].dataType.typeName()
    x = F.col("features") if kind == "array" else vector_to_array("features")
    w = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    rows = train.select(x.alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    out = np.zeros((q, q))
    out[low, high] = task_sums(rows, len(low), add)
    return out + np.triu(out, 1).T


def _solve(g: np.ndarray, chosen: Sequence[int]) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of the outcome (last column) on the chosen ones."""
    a = np.array(chosen)
    scale = np.sqrt(np.maximum(np.diag(g)[a], 1e-300))
    coef = np.linalg.lstsq(g[np.ix_(a, a)] / np.outer(scale, scale), g[a, -1] / scale, rcond=1e-11)[0] / scale
    return coef, float(max(g[-1, -1] - coef @ g[a, -1], 0.0))


def search_splines(
    train: DataFrame, knots: Mapping[int, Sequence[float]], terms: int = 21, threshold: float = 0.001, penalty: float = 2.0, label: str = "label"
) -> Splines:
    """Hinge pairs added while they remove ``threshold`` of the outcome's variation, then single hinges pruned.

    ``knots`` are the candidates of every feature (for instance ``feature_knots``).  Pruning keeps
    the set of smallest residual / (1 - cost / n)^2, a term costing one and each knot
    ``penalty / 2`` more.  ``terms`` limits the forward pass, the constant included.
    """
    hinges = [Hinge(j, float(t), up) for j, ts in sorted(knots.items()) for t in ts for up in (True, False)]
    if len(hinges) > MAX_COLUMNS:
        raise ValueError(f"{len(hinges)} candidate hinges; more than {MAX_COLUMNS} are refused")
    g = _products(train, hinges, label)
    n = g[0, 0]
    if n <= 0:
        return Splines((), (0.0,), 0.0, 0.0)
    chosen, (_, rss) = [0], _solve(g, [0])
    total = max(rss, 1e-300)
    while len(chosen) + 2 <= terms and rss > 1e-12 * total:
        a = np.array(chosen)
        scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
        s = g / np.outer(scale, scale)
        # What the chosen columns leave of every other one.
        left = s - s[:, a] @ np.linalg.lstsq(s[np.ix_(a, a)], s[a, :], rcond=1e-11)[0]
        best, pair = 0.0, None
        for p in range(1, len(g) - 1, 2):
            new = [c for c in (p, p + 1) if c not in chosen and left[c, c] > 1e-9]
            if new:
                i = np.array(new)
                gain = float(left[i, -1] @ np.linalg.lstsq(left[np.ix_(i, i)], left[i, -1], rcond=1e-9)[0]) * g[-1, -1]
                if gain > best * (1 + 1e-9):
                    best, pair = gain, new
        if pair is None or best < threshold * total:
            break
        chosen += pair
        rss = _solve(g, chosen)[1]

    def worth(terms_: Sequence[int], residual: float) -> float:
        cost = len(terms_) + penalty * (len(terms_) - 1) / 2
        return residual / max(1.0 - cost / n, 1e-9) ** 2

    best_set, best_worth = list(chosen), worth(chosen, rss)
    while len(chosen) > 1:
        options = [(_solve(g, [c for c in chosen if c != out])[1], out) for out in chosen[1:]]
        residual, out = min(options)
        chosen = [c for c in chosen if c != out]
        # Of sets that are as good the smaller one stays.
        if worth(chosen, residual) <= best_worth * (1 + 1e-9) + 1e-12 * total:
            best_set, best_worth = list(chosen), worth(chosen, residual)
    coef, residual = _solve(g, best_set)
    return Splines(tuple(hinges[c - 1] for c in best_set[1:]), tuple(float(c) for c in coef), residual, float(n))


def hinge_columns(df: DataFrame, hinges: Sequence[Hinge], name: str = "features") -> DataFrame:
    """Replace the feature array by the chosen hinges."""
    kind = df.schema["features"].dataType.typeName()
    x = F.col("features") if kind == "array" else vector_to_array("features")
    out = df.withColumn("__x", x)
    at = lambda h: F.element_at("__x", h.feature + 1)
    made = [F.greatest((at(h) - F.lit(h.knot)) if h.up else (F.lit(h.knot) - at(h)), F.lit(0.0)) for h in hinges]
    return out.withColumn(name, F.array(*made) if made else F.array().cast("array<double>")).drop("__x")
