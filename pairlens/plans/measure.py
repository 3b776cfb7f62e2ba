"""The two long paths: imputed directed replicates, and the risk measure of every unit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import models as M
from ..operators import sampling as G
from ..operators import validation as V
from ..operators.ensemble import ensemble_weights
from ..operators.imputation import em_impute
from ..operators.pairs import PAIR, attach_sides, make_pairs, mirror_pairs
from ..operators.scoring import blend, score_models, unit_risk
from ..session import materialize, scratch_path
from ..sources import write_replicates


def directed_replicates(
    panel: DataFrame,
    unit: str,
    period: str,
    attrs: Sequence[str],
    pair_variables: DataFrame,
    panel_options: Mapping,
    pair_options: Mapping,
    m_panel: int = 5,
    m_pairs: int = 5,
) -> str:
    """Impute the panel, pair it, impute the pairs, mirror: returns the folder of replicates.

    ``pair_variables(a_unit, b_unit, period, ...)`` are computed once on keys and joined to
    every replicate of the panel.  Replicate ``(imp_i, imp_j)`` is pair imputation j of panel
    imputation i.
    """
    spark = panel.sparkSession
    keyed = panel.withColumn("row_id", F.concat_ws("_", unit, period))
    complete = materialize(em_impute(keyed, "row_id", period, unit, m=m_panel, name="imp_i", **panel_options), "panel-imputed")
    variables = materialize(pair_variables, "pair-variables")
    path = scratch_path(spark, "directed-replicates")
    # All copies of the panel go through one imputation, so 5 x 5 replicates take the scans of one.
    wide = attach_sides(make_pairs(complete, unit, period), complete, attrs, unit, period, by=["imp_i"])
    wide = wide.join(variables, [*PAIR, period]).withColumn("pair_id", F.concat_ws("_", *PAIR, period))
    done = em_impute(materialize(wide, "pairs"), "pair_id", period, None, idvars=PAIR, m=m_pairs, name="imp_j", stored=True, by="imp_i", **pair_options)
    write_replicates(mirror_pairs(done.drop("pair_id")), path, ("imp_i", "imp_j"))
    return path


def risk_measure(
    frame: DataFrame,
    units: DataFrame,
    families: Sequence[str] = ("null", "logit", "forest"),
    ratio: float = 100,
    folds: int = 10,
    seed: int = 90210,
    period: str = "year",
) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Risk per target unit and period, held-out scores, and the ensemble weights.

    ``frame`` is ``row_id, label, features``; ``units`` maps its ``row_id`` to ``unit`` and
    ``period``.  Split, down-sample the training part, cross-validate each family there,
    weigh them on the out-of-fold predictions, refit, predict every row, and combine.
    """
    split = materialize(G.train_eval_test(frame, "label", "row_id", seeds=(seed, 555)), "split", rebalance=True)
    train = split.where("part = 'train'").select("row_id", "label", "features")
    sample = G.resample(train, "label", seed, "row_id", ratio, 1.0, 0.0, as_weights=True)
    sample = sample.withColumn("weight", F.col("n_draws").cast("double")).drop("n_draws")
    sample = materialize(G.assign_folds(sample, folds, seed, "label", "row_id"), "down-sample", rebalance=True)

    # Every family is tried at its first setting; tuning is cross_validate over its grid.
    parts = [V.cross_validate(sample, f, [M.FAMILIES[f].grid[0]], parallelism=8).predictions for f in families]
    held = materialize(reduce(DataFrame.unionByName, parts), "out-of-fold", rebalance=True)
    weights = ensemble_weights(held, list(families))

    preds, _ = M.fit_many(sample.drop("fold"), split.select("row_id", "label", "features"), list(families))
    preds = materialize(preds, "predictions")
    mixed = blend(preds, weights, "row_id", ["label"])
    unseen = split.where("part = 'eval'").select("row_id")
    scores = score_models(preds.unionByName(mixed.select(preds.columns)).join(unseen, "row_id", "left_semi"))
    risk = unit_risk(mixed.join(units, "row_id"), "unit", period)
    return risk, scores, weights


