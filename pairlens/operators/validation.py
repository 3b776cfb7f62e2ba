"""Cross-validation, tuning, importance, and the class-ratio curve."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import hash_rank
from ..session import materialize
from .batch_logit import fit_logits, fold_samples, held_out_loss, linear_probability, packed_counts, prepared, score_fits
from .models import FAMILIES, Family, Scorer
from .sampling import DRAW_BLOCK, block_draws, class_sizes
from .scoring import auc, log_loss, log_loss_term, row_weight


# Scans of the rows that logits of bootstraps and of folds may take.
MAX_SCANS, CV_SCANS = 20, 40
TUNED_TOGETHER = 4


@dataclass(frozen=True)
class CrossValidation:
    model: str
    best: Mapping
    predictions: DataFrame
    results: DataFrame
    seconds: float


def _family(family: Family | str) -> Family:
    return FAMILIES[family] if isinstance(family, str) else family


def cross_validate(
    df: DataFrame,
    family: Family | str,
    grid: Sequence[Mapping] | None = None,
    fold: str = "fold",
    seed: int = 555,
    parallelism: int = 4,
    metric: str = "log_loss",
) -> CrossValidation:
    """Out-of-fold probabilities for the best setting, and the log-loss of every setting.

    ``metric`` is ``log_loss`` or ``auc``; the best setting has the lowest loss or the highest
    area, taken over all held-out rows.  A ``weight`` column weighs fits, losses and areas, and
    stays in the predictions.  ``df`` carries a fold id and should be a stored table.  Logits of all settings and folds are fitted
    together, a scan of the rows per step; other families' fits run a few at a time from a small
    thread pool, each one itself a distributed job.  Only numbers per fit reach the driver.
    """
    if metric not in ("log_loss", "auc"):
        raise ValueError(f"unknown metric {metric}")
    fam = _family(family)
    settings = list(grid or fam.grid)
    weight = "weight" if "weight" in df.columns else None
    began = time.perf_counter()
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())

    def one(task: tuple[int, int]) -> tuple[int, int, Scorer, float, int, float]:
        i, k = task
        start = time.perf_counter()
        scorer = fam.fit(data.where(F.col(fold) != k).drop(fold), settings[i], seed)
        held = scorer(data.where(F.col(fold) == k))
        w = row_weight(weight)
        loss, n = held.agg(F.sum(w * log_loss_term(F.col("label"), F.col("p"))), F.sum(w)).first()
        return i, k, scorer, float(loss), float(n), time.perf_counter() - start

    tasks = [(i, k) for i in range(len(settings)) for k in folds]
    if fam.penalty:
        done = _logit_folds(data, fam, settings, fold, folds, weight)
    else:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            done = list(pool.map(one, tasks))
    data.unpersist()
    rows = []
    for i, params in enumerate(settings):
        mine = [d for d in done if d[0] == i]
        loss = sum(d[3] for d in mine) / sum(d[4] for d in mine)
        rows.append((fam.name, json.dumps(dict(params), sort_keys=True), float(loss), len(mine), sum(d[5] for d in mine)))

    def out_of_fold(setting: int) -> DataFrame:
        keep = ["row_id", "label", fold, *([weight] if weight else [])]
        parts = [scorer(df.where(F.col(fold) == k)).select(*keep, F.lit(fam.name).alias("model"), "p") for i, k, scorer, *_ in done if i == setting]
        return reduce(DataFrame.unionByName, parts)

    if metric == "auc":
        areas = [auc(out_of_fold(i), "label", "p", weight=weight).first()[0] for i in range(len(settings))]
        best = max(range(len(settings)), key=lambda i: (-1.0 if areas[i] is None else areas[i], -i))
    else:
        best = min(range(len(settings)), key=lambda i: (rows[i][2], i))
    predictions = out_of_fold(best)
    results = df.sparkSession.createDataFrame(
        rows, "model string, setting string, log_loss double, n_fits int, seconds double"
    )
    return CrossValidation(fam.name, settings[best], predictions, results, time.perf_counter() - began)


def _logit_folds(data: DataFrame, fam: Family, settings: Sequence[Mapping], fold: str, folds: Sequence, weight: str | None) -> list[tuple]:
    """Setting, fold, scorer, summed loss, weight and seconds of every logit, all fitted together."""
    start = time.perf_counter()
    rows = fold_samples(data, fold, folds, weight).persist(StorageLevel.MEMORY_AND_DISK)
    fits = fit_logits(rows, len(folds), [fam.penalty(s) for s in settings], max_scans=CV_SCANS)
    loss, total = held_out_loss(rows, fits, len(folds))
    rows.unpersist()

    def scorer(f: int) -> Scorer:
        return lambda df: df.withColumn("p", linear_probability(vector_to_array("features"), fits.coef[f], fits.intercept[f]))

    seconds = (time.perf_counter() - start) / max(len(fits.coef), 1)
    each = len(settings)
    return [(i, k, scorer(j * each + i), float(loss[i, j]), float(total[j]), seconds) for i in range(each) for j, k in enumerate(folds)]


def tuning_stability(
    df: DataFrame, replicate: Sequence[str], families: Sequence[str], grids: Mapping[str, Sequence[Mapping]] | None = None, **kw
) -> DataFrame:
    """Best setting per imputed replicate and family, with its log-loss.

    Replicates and families are tuned side by side, ``TUNED_TOGETHER`` of them at a time.
    """
    keys = [tuple(r) for r in df.select(*replicate).distinct().orderBy(*replicate).collect()]

    def tune(task: tuple[tuple, str]) -> tuple:
        key, family = task
        one = df
        for name, value in zip(replicate, key):
            one = one.where(F.col(name) == value)
        cv = cross_validate(one.drop(*replicate), family, (grids or {}).get(family), **kw)
        best = min(r["log_loss"] for r in cv.results.collect())
        return (*key, family, json.dumps(dict(cv.best), sort_keys=True), float(best))

    with ThreadPoolExecutor(max_workers=TUNED_TOGETHER) as pool:
        out = list(pool.map(tune, [(key, f) for key in keys for f in families]))
    names = ", ".join(f"{n} int" for n in replicate)
    return df.sparkSession.createDataFrame(out, f"{names}, model string, setting string, log_loss double")


def permutation_importance(scorer: Scorer, df: DataFrame, features: Sequence[str], seed: int = 555) -> DataFrame:
    """Rise of the log-loss when one feature's values are handed to other rows.

    One md5 order is matched with another to give each row a donor: a single join serves
    all features.  Every feature's exchanged rows are scored in the same pass.
    """
    base = df.select("row_id", "label", "features")
    here = hash_rank(base, "row_id", [], f"{seed}:a", "__rank")
    donors = hash_rank(base, "row_id", [], f"{seed}:b", "__rank").select(
        "__rank", vector_to_array("features").alias("__donor")
    )
    pairs = here.join(donors, "__rank").withColumn("__own", vector_to_array("features"))

    def exchanged(j: int):
        donor = F.element_at(F.col("__donor"), j + 1)
        return F.transform("__own", lambda v, i: F.when(i == j, donor).otherwise(v))

    swaps = [F.struct(F.lit(name).alias("feature"), exchanged(j).alias("x")) for j, name in enumerate(features)]
    swapped = pairs.select("row_id", "label", F.inline(F.array(*swaps)))
    swapped = swapped.withColumn("features", array_to_vector("x")).drop("x")
    shuffled = log_loss(scorer(swapped), "label", "p", ["feature"])
    plain = log_loss(scorer(base), "label", "p").scalar()
    return shuffled.select("feature", (F.col("log_loss") - plain).alias("importance"))


# Negatives per positive that the curve tries, before the natural ratio.
RATIOS = (1, 2, 3, 4, 5, 10, 25, 50, 100, 250)


def downsample_curve(
    train: DataFrame,
    evaluation: DataFrame,
    ratios: Sequence[float] = RATIOS,
    reps: int = 100,
    seed: int = 90210,
    natural: bool = True,
) -> DataFrame:
    """Log-loss and AUC on held-out rows for logits fitted on bootstraps of several class ratios.

    The training rows are ranked once, and the draws of a block of ranks are counted where its rows
    are: no draw is moved, and a row carries one number per fit.  All fits take their Newton steps
    together, one scan of the drawn rows each, ``MAX_SCANS`` at most (a bootstrap whose classes
    separate stops there); two scans of the held-out rows score them all.
    """
    spark = train.sparkSession
    sizes = class_sizes(train, "label")
    n1, n0 = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not n1 or not n0:
        raise ValueError("both classes are needed")
    wanted = [float(r) for r in ratios] + ([n0 / n1] if natural else [])
    ranked = hash_rank(train.select("row_id", "label", "features"), "row_id", ["label"], seed, "__rank")
    place = F.col("__rank") - 1
    blocks = prepared(ranked.where("label IN (0, 1)"), block=F.floor(place / DRAW_BLOCK), place=place % DRAW_BLOCK)
    n = {1.0: np.full(len(wanted) * reps, n1), 0.0: np.repeat([int(n1 * r) for r in wanted], reps)}

    def count(table: pa.Table) -> pa.Table:
        label, block = (table.column(c)[0].as_py() for c in ("label", "block"))
        drawn = block_draws(n[label], sizes[label], block, f"{seed}:{label}").T[table.column("place").to_numpy()]
        used = drawn.any(axis=1)
        return table.select(["label", "x", "w"]).filter(pa.array(used)).append_column("drawn", packed_counts(drawn[used]))

    counted = blocks.groupBy("label", "block").applyInArrow(count, blocks.select("label", "x", "w", F.lit(b"").alias("drawn")).schema)
    # As many files as tasks run at once, since a scan costs by the row and not by the byte.
    rows = materialize(counted.repartition(2 * spark.sparkContext.defaultParallelism), "bootstraps")
    fits = fit_logits(rows, len(wanted) * reps, max_scans=MAX_SCANS)
    scored = score_fits(materialize(prepared(evaluation), "held-out", rebalance=True), fits)
    table = [(wanted[i // reps], i % reps + 1, loss, area) for i, (loss, area) in enumerate(scored)]
    return spark.createDataFrame(table, "ratio double, rep int, log_loss double, auc double")
