"""Discrete boosting by reweighting (Freund and Schapire, 1997), with one-split trees.

Weights are a column.  A round is one scan that sums the weights of both classes below every
candidate threshold; the driver picks the split of smallest weighted error, and the next
round's weights follow from it.  After some rounds the weights are written as a table, which
keeps expressions short and gives lost executors a place to start again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import matrix, task_sums
from ..session import materialize

#: Rounds between two written tables of weights, and the least error a split is credited with.
WRITE_EVERY, LEAST_ERROR = 10, 1e-10


@dataclass(frozen=True)
class Stump:
    """Votes ``sign`` (1 or -1) where the feature is above the threshold and ``-sign`` elsewhere, with ``weight``."""

    feature: int
    threshold: float
    sign: int
    weight: float
    error: float

    def vote(self, x: Column | str) -> Column:
        above = F.element_at(F.col(x) if isinstance(x, str) else x, self.feature + 1) > F.lit(self.threshold)
        return F.when(above, F.lit(float(self.sign))).otherwise(F.lit(float(-self.sign)))


def _best(rows: DataFrame, knots: Mapping[int, Sequence[float]]) -> tuple[int, float, int, float]:
    """Feature, threshold, sign and error share of the best split; the first of equal ones."""
    order = [(j, t) for j, ts in sorted(knots.items()) for t in ts]
    size = len(order) + 1

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        out = total.reshape(2, size)
        x, y, w = matrix(batch.column("x")), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
        at = 0
        for j, ts in sorted(knots.items()):
            # The first threshold that a value does not exceed; sums up to a threshold follow from these.
            place = np.searchsorted(np.asarray(ts), x[:, j], side="left")
            for side in (0, 1):
                out[side, at : at + len(ts)] += np.bincount(place[y == (1.0 if side else -1.0)], w[y == (1.0 if side else -1.0)], len(ts) + 1)[:-1]
            at += len(ts)
        out[0, -1] += w[y < 0].sum()
        out[1, -1] += w[y > 0].sum()

    sums = task_sums(rows.select("x", "y", "w"), 2 * size, add).reshape(2, size)
    total, at, best = sums[:, -1], 0, (np.inf, 0, 0.0, 1)
    for j, ts in sorted(knots.items()):
        below = np.cumsum(sums[:, at : at + len(ts)], axis=1)
        for sign in (1, -1):
            # Wrong are positives on the negative side and the converse.
            wrong = below[1] + total[0] - below[0] if sign == 1 else below[0] + total[1] - below[1]
            k = int(np.argmin(wrong)) if len(ts) else 0
            if len(ts) and wrong[k] < best[0] - 1e-12 * total.sum():
                best = (float(wrong[k]), j, float(ts[k]), sign)
        at += len(ts)
    return best[1], best[2], best[3], best[0] / max(total.sum(), 1e-300)


def fit_stumps(train: DataFrame, knots: Mapping[int, Sequence[float]], rounds: int = 50) -> list[Stump]:
    """Splits in order.  Stops early where none is better than chance, and after one that makes no error.

    ``train`` has ``label, features[, weight]``.
    """
    w = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    y = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    rows = materialize(train.select(vector_to_array("features").alias("x"), y.alias("y"), w.alias("w")), "boosting", rebalance=True)
    stumps: list[Stump] = []
    for turn in range(1, rounds + 1):
        j, t, sign, error = _best(rows, knots)
        if not error < 0.5 - 1e-9:
            break
        clean = max(error, LEAST_ERROR)
        stump = Stump(j, t, sign, 0.5 * float(np.log((1 - clean) / clean)), error)
        stumps.append(stump)
        if error <= LEAST_ERROR:
            break
        # Weights are brought back to a mean near that of the round before, so that they do not fade.
        fade = 2.0 * float(np.sqrt(clean * (1 - clean)))
        rows = rows.withColumn("w", F.col("w") * F.exp(-F.lit(stump.weight) * F.col("y") * stump.vote("x")) / F.lit(fade))
        if turn % WRITE_EVERY == 0 and turn < rounds:
            rows = materialize(rows, "boosting")
    return stumps


def margin(stumps: Sequence[Stump], x: str) -> Column:
    out = F.lit(0.0)
    for s in stumps:
        out = out + F.lit(s.weight) * s.vote(x)
    return out


def training_bound(stumps: Sequence[Stump]) -> list[float]:
    """After each round, what the share of wrongly called training weight cannot exceed."""
    return np.cumprod([2.0 * np.sqrt(s.error * (1 - s.error)) for s in stumps]).tolist()


def stump_scorer(stumps: Sequence[Stump]):
    """Probability from the margin: half the log odds is what the weighted votes estimate."""

    def score(df: DataFrame) -> DataFrame:
        out = df.withColumn("__x", vector_to_array("features"))
        return out.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin(stumps, "__x")))).drop("__x")

    return score
