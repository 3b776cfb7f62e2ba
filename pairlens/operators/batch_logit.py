"""Many logits in one pass.

All fits share the rows and differ in how often each row counts (bootstraps, folds) and in
their penalties.  A row carries a vector of weights, one per sample.  Each scan of the rows
returns loss, gradient and curvature of every fit, added up in the tasks; the driver takes
Newton steps, by coordinate descent where a penalty bends them.  The number of scans does not
depend on the number of fits.

Fitted models are scored together as well: one scan sums the loss of every fit, and the area
under the curve from the rank of each negative among the positives, which are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import matrix, task_sums
from .scoring import EPS, auc, log_loss

# Numbers that a task holds at once for the scores of some rows, and bytes of positive scores that are broadcast.
BLOCK_NUMBERS, POSITIVE_BYTES = 1 << 20, 16 << 20


@dataclass(frozen=True)
class Fits:
    """``coef`` has a row per fit; fits of one sample stand together, one per penalty."""

    coef: np.ndarray
    intercept: np.ndarray
    converged: np.ndarray
    scans: int


def prepared(df: DataFrame, weights: str | None = None, weight: str | None = None, **more: Column) -> DataFrame:
    """``label, x, w`` [``, samples, counts``] and columns in ``more``: what the scans read.

    ``weights`` names an array of ``(sample, count)`` structs, samples numbered from 0; without
    it there is one sample, which all rows belong to.  ``weight`` multiplies a row's counts.
    """
    kind = df.schema["features"].dataType.typeName()
    x = F.col("features") if kind == "array" else vector_to_array("features")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    columns = [F.col("label").cast("double").alias("label"), x.alias("x"), w.alias("w")]
    if weights:
        columns += [F.col(weights)["sample"].cast("array<int>").alias("samples"), F.col(weights)["count"].cast("array<double>").alias("counts")]
    return df.select(*columns, *(c.alias(n) for n, c in more.items()))


def packed_counts(counts: np.ndarray) -> pa.Array:
    """One binary value a row (rows x samples), each count in as many bytes as the largest needs."""
    small = counts.astype(np.min_scalar_type(counts.max(initial=0)))
    return pa.array([r.tobytes() for r in small], pa.binary())


def unpacked_counts(column: pa.Array, samples: int) -> np.ndarray:
    """The counts of ``packed_counts``; rows may have been packed apart, in numbers of other widths."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, width = np.frombuffer(column.buffers()[2], np.uint8), np.diff(offsets) // samples
    out = np.empty((len(column), samples))
    for size in np.unique(width).tolist():
        mine = np.flatnonzero(width == size)
        if len(mine) == len(column):
            flat = data[offsets[0] : offsets[-1]]
        else:
            flat = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in mine])
        out[mine] = flat.view(f"u{size}").reshape(len(mine), samples)
    return out


def _weight_matrix(batch: pa.RecordBatch, samples: int) -> np.ndarray:
    w = batch.column("w").to_numpy(zero_copy_only=False)
    if "drawn" in batch.schema.names:
        return unpacked_counts(batch.column("drawn"), samples) * w[:, None]
    if "samples" not in batch.schema.names:
        return np.repeat(w[:, None], samples, axis=1)
    lists = batch.column("samples")
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((batch.num_rows, samples))
    rows = np.repeat(np.arange(batch.num_rows), n)
    np.add.at(out, (rows, lists.flatten().to_numpy(zero_copy_only=False)), batch.column("counts").flatten().to_numpy(zero_copy_only=False) * w[rows])
    return out


def _pieces(batch: pa.RecordBatch, wide: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_NUMBERS // max(wide, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _moments(rows: DataFrame, width: int, samples: int) -> np.ndarray:
    """Per sample: sum of weights, of weighted labels, and weighted sums of x and x squared."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        out = total.reshape(2 + 2 * width, samples)
        for part in _pieces(batch, samples):
            x, y, w = matrix(part.column("x")), part.column("label").to_numpy(zero_copy_only=False), _weight_matrix(part, samples)
            out += np.concatenate((np.ones((1, len(y))), y[None], x.T, (x * x).T)) @ w

    return task_sums(rows, (2 + 2 * width) * samples, add).reshape(2 + 2 * width, samples)


def _scan(rows: DataFrame, beta: np.ndarray, samples: int, of: np.ndarray, center: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weighted loss, gradient and packed curvature at ``beta`` (fits x width + 1, intercept last); ``of`` is each fit's sample."""
    fits, k = beta.shape
    low, high = np.triu_indices(k)
    size = 1 + k + len(low)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        out = total.reshape(size, fits)
        for part in _pieces(batch, max(fits, samples)):
            x = (matrix(part.column("x")) - center) / scale
            x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
            y, w = part.column("label").to_numpy(zero_copy_only=False)[:, None], _weight_matrix(part, samples)[:, of]
            used = w.any(axis=1)
            x, y, w = x[used], y[used], w[used]
            s = x @ beta.T
            e = np.exp(-np.abs(s))
            p = np.where(s >= 0, 1.0, e) / (1.0 + e)
            # log(1 + exp(s)) - y * s, by the smaller exponential.
            out[0] += np.einsum("rf,rf->f", w, np.maximum(s, 0.0) - y * s + np.log1p(e))
            out[1 : 1 + k] += x.T @ (w * (p - y))
            out[1 + k :] += (x[:, low] * x[:, high]).T @ (w * (e / (1.0 + e) ** 2))

    out = task_sums(rows, size * fits, add).reshape(size, fits)
    curve = np.zeros((fits, k, k))
    curve[:, low, high] = curve[:, high, low] = out[1 + k :].T
    return out[0], out[1 : 1 + k].T, curve


def _newton(beta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Steps that minimise the local quadratic model plus the penalties, for all fits at once."""
    k = beta.shape[1]
    g, h = g + l2 * beta, h + np.einsum("fi,ij->fij", l2, np.eye(k))
    # Directions without curvature (constant columns, separated classes) get no step of their own.
    h = h + (1e-10 * np.einsum("fii->f", h) / k + 1e-14)[:, None, None] * np.eye(k)
    if not l1.any():
        return -np.linalg.solve(h, g[:, :, None])[:, :, 0]
    step, slope = np.zeros_like(beta), g.copy()
    for _ in range(2000):
        largest = 0.0
        for j in range(k):
            curve = h[:, j, j]
            z = curve * (beta[:, j] + step[:, j]) - slope[:, j]
            new = np.sign(z) * np.maximum(np.abs(z) - l1[:, j], 0.0) / curve - beta[:, j]
            change = new - step[:, j]
            slope += h[:, :, j] * change[:, None]
            step[:, j] = new
            largest = max(largest, float(np.abs(change).max()))
        if largest < 1e-10:
            break
    return step


def fit_logits(rows: DataFrame, samples: int = 1, penalties: Sequence[tuple[float, float]] = ((0.0, 0.0),), max_scans: int = 20, tol: float = 1e-12) -> Fits:
    """Logits of every sample under every penalty ``(alpha, lambda)``; fit ``s * len(penalties) + i`` is sample s, penalty i.

    ``rows`` comes from ``prepared`` and should be a stored table.  The mean loss of a sample's
    rows plus ``lambda * (alpha |b| + (1 - alpha) / 2 b^2)`` is minimised, b being coefficients
    of features scaled by the sample's standard deviations; the intercept is free.  A column
    that is constant in a sample gets the coefficient 0.

    A sample whose classes can be separated has no best fit: its coefficients grow until
    ``max_scans`` and ``converged`` is false.  A sample of one class only keeps its base rate.
    """
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    width, each = first["n"], len(penalties)
    sums = _moments(rows, width, samples)
    n, positives = np.maximum(sums[0], 1e-300), sums[1]
    mean = sums[2 : 2 + width] / n
    deviation = np.sqrt(np.maximum(sums[2 + width :] / n - mean**2, 0.0) * n / np.maximum(n - 1.0, 1.0)).T
    # One scale for all fits keeps the numbers even; penalties refer to each sample's own.
    whole = sums.sum(axis=1)
    center = whole[2 : 2 + width] / max(whole[0], 1e-300)
    scale = np.sqrt(np.maximum(whole[2 + width :] / max(whole[0], 1e-300) - center**2, 0.0))
    scale[scale <= 1e-12 * np.maximum(np.abs(center), 1.0)] = 1.0
    ratio = np.repeat(deviation / scale, each, axis=0)
    flat = np.concatenate((ratio <= 1e-9, np.zeros((samples * each, 1), bool)), axis=1)
    alpha, lam = (np.tile([p[i] for p in penalties], samples)[:, None] for i in (0, 1))
    none = np.zeros((samples * each, 1))
    l1, l2 = np.concatenate((lam * alpha * ratio, none), axis=1), np.concatenate((lam * (1 - alpha) * ratio**2, none), axis=1)

    count = np.repeat(n, each)
    rate = np.clip(np.repeat(positives / n, each), 1e-12, 1 - 1e-12)
    beta = np.zeros((samples * each, width + 1))
    beta[:, -1] = np.log(rate / (1 - rate))
    # Samples without rows, or of one class, have nothing to fit beyond their base rate.
    mixed = np.repeat((positives > 0) & (positives < sums[0]), each)
    done, converged = ~mixed, ~mixed
    worth = np.full(len(beta), np.inf)
    tried, best, step, size = beta.copy(), beta.copy(), np.zeros_like(beta), np.ones(len(beta))
    scans = 1
    while not done.all() and scans < max_scans:
        live = np.flatnonzero(~done)
        loss, g, h = _scan(rows, tried[live], samples, live // each, center, scale)
        scans += 1
        loss, g, h = loss / count[live], g / count[live, None], h / count[live, None, None]
        value = loss + (l1[live] * np.abs(tried[live]) + l2[live] / 2 * tried[live] ** 2).sum(axis=1)
        better = value <= worth[live] + 1e-14 * np.maximum(1.0, np.abs(worth[live]))
        up, back = live[better], live[~better]
        size[back] /= 2
        tried[back] = best[back] + size[back, None] * step[back]
        worth[up], best[up], size[up] = value[better], tried[up], 1.0
        fixed = flat[up]
        g, h = np.where(fixed, 0.0, g[better]), np.where(fixed[:, :, None] | fixed[:, None, :], 0.0, h[better])
        h = h + np.einsum("fi,ij->fij", fixed.astype(float), np.eye(width + 1))
        step[up] = np.where(fixed, 0.0, _newton(best[up], g, h, l1[up], l2[up]))
        tried[up] = best[up] + step[up]
        # What a step can still gain falls with the square of its length, so the last one needs no scan.
        gain = np.einsum("fi,fij,fj->f", step[up], h, step[up])
        ready = up[gain <= tol]
        best[ready] = tried[ready]
        done[ready] = converged[ready] = True
        done[back[size[back] < 1e-6]] = True
    coef = best[:, :-1] / scale
    return Fits(coef, best[:, -1] - coef @ center, converged, scans)


def scores(x: np.ndarray, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Probabilities (rows x fits); equal rows get equal numbers whatever stands beside them, so that ties stay ties."""
    s = np.repeat(intercept[None, :], len(x), axis=0)
    for j in range(x.shape[1]):
        s += x[:, j : j + 1] * coef[None, :, j]
    return 1.0 / (1.0 + np.exp(-np.clip(s, -700, 700)))


def _positive_scores(positives: DataFrame, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Sorted scores of the positive rows, one row of the result per fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, len(coef)):
                p = scores(matrix(part.column("x")), coef, intercept)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in p], pa.binary())], names=["p"])

    rows = positives.select("x").mapInArrow(run, "p binary").collect()
    return np.sort(np.stack([np.frombuffer(r["p"], np.float64) for r in rows], axis=1), axis=1)


def score_fits(rows: DataFrame, fits: Fits, eps: float = EPS) -> list[tuple[float, float | None]]:
    """Log-loss and area under the curve of every fit on ``rows`` (from ``prepared``, each row counting once).

    The scores of the positives are sorted and sent to all tasks, in groups of fits that keep
    them below ``POSITIVE_BYTES``; each negative then finds its rank by binary search, ties
    counting half, and only sums leave the tasks.  Where the positives of a single fit are too
    many, that fit is ranked by an ordinary shuffle.  The area is None if a class is absent.
    """
    n1 = rows.where("label = 1").count()
    group = POSITIVE_BYTES // (8 * max(n1, 1))
    out: list[tuple[float, float | None]] = []
    if not group:
        return [_ranked(rows, c, i, eps) for c, i in zip(fits.coef, fits.intercept)]
    for at in range(0, len(fits.coef), group):
        out += _score_group(rows, fits.coef[at : at + group], fits.intercept[at : at + group], n1, eps)
    return out


def _score_group(rows: DataFrame, coef: np.ndarray, intercept: np.ndarray, n1: int, eps: float) -> list[tuple[float, float | None]]:
    fits = len(coef)
    above = _positive_scores(rows.where("label = 1"), coef, intercept) if n1 else np.zeros((fits, 0))
    shared = rows.sparkSession.sparkContext.broadcast(above)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        out, ranks = total.reshape(3, fits), shared.value
        for part in _pieces(batch, fits):
            y = part.column("label").to_numpy(zero_copy_only=False)
            p = scores(matrix(part.column("x")), coef, intercept)
            out[0] += np.where(y[:, None] == 1, -np.log(p + eps), -np.log(1.0 - p + eps)).sum(axis=0)
            out[2] += (y == 0).sum()
            low = p[y == 0]
            for f in range(fits):
                left, right = np.searchsorted(ranks[f], low[:, f], side="left"), np.searchsorted(ranks[f], low[:, f], side="right")
                out[1, f] += 2 * n1 * len(low) - left.sum() - right.sum()

    loss, twice, n0 = task_sums(rows, 3 * fits, add).reshape(3, fits)
    shared.unpersist()
    return [(float(a / (n1 + c)) if n1 + c else float("nan"), float(b / (2.0 * n1 * c)) if n1 and c else None) for a, b, c in zip(loss, twice, n0)]


def _ranked(rows: DataFrame, coef: np.ndarray, intercept: float, eps: float) -> tuple[float, float | None]:
    scored = scored_by(rows, coef, intercept)
    return log_loss(scored, "label", "p", eps=eps).first()[0], auc(scored, "label", "p").first()[0]


def linear_probability(x: Column | str, coef: Sequence[float], intercept: float) -> Column:
    """The probability of one fit as a Column over the array ``x``."""
    dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in coef]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(float(intercept)))))


def scored_by(rows: DataFrame, coef: Sequence[float], intercept: float) -> DataFrame:
    return rows.withColumn("p", linear_probability("x", coef, intercept))


def fold_samples(df: DataFrame, fold: str, folds: Sequence, weight: str | None = None) -> DataFrame:
    """Rows for ``fit_logits`` with one sample per fold, which all rows of the other folds belong to; ``held`` numbers a row's own."""
    every = F.array(*[F.struct(F.lit(i).alias("sample"), F.lit(1.0).alias("count")) for i in range(len(folds))])
    held = F.coalesce(*[F.when(F.col(fold) == F.lit(k), F.lit(i)) for i, k in enumerate(folds)])
    marked = df.withColumn("__held", held).withColumn("__draws", F.filter(every, lambda s: s["sample"] != F.col("__held")))
    return prepared(marked, "__draws", weight, held=F.col("__held"))


def held_out_loss(rows: DataFrame, fits: Fits, folds: int, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """Summed weighted loss (settings x folds) of the fold that each row was held out of, and the folds' weights."""
    each = len(fits.coef) // folds

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        out = total.reshape(each + 1, folds)
        for part in _pieces(batch, len(fits.coef)):
            y, w = (part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("label", "w"))
            held = part.column("held").to_numpy(zero_copy_only=False)
            mine = held[:, None] * each + np.arange(each)
            p = np.take_along_axis(scores(matrix(part.column("x")), fits.coef, fits.intercept), mine, axis=1)
            loss = w * np.where(y == 1, -np.log(p + eps), -np.log(1.0 - p + eps))
            np.add.at(out.T, held, np.concatenate((loss, w), axis=1))

    out = task_sums(rows, (each + 1) * folds, add).reshape(each + 1, folds)
    return out[:-1], out[-1]
