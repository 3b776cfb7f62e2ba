"""Scores of probability predictions, long table ``row_id, model, p`` plus the outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bounded, ranked_counts

# Fixed value: double machine epsilon, added inside both logarithms.
EPS = 2.220446049250313e-16


def log_loss_term(y: Column, p: Column, eps: float = EPS) -> Column:
    e = F.lit(eps)
    return -(y * F.ln(p + e) + (F.lit(1) - y) * F.ln(F.lit(1.0) - p + e))


def row_weight(weight: str | None) -> Column:
    """A row's weight, or one; a weighted row counts as that many equal rows."""
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def weighted_mean(value: Column, weight: str | None) -> Column:
    if not weight:
        return F.avg(value)
    w = F.when(value.isNotNull(), row_weight(weight))
    return F.try_divide(F.sum(value * w), F.sum(w))


def log_loss(df: DataFrame, y: str, p: str, by: Sequence[str] = (), eps: float = EPS, weight: str | None = None) -> DataFrame:
    """Mean log-loss, weighted if a weight column is named."""
    return df.groupBy(*by).agg(weighted_mean(log_loss_term(F.col(y), F.col(p), eps), weight).alias("log_loss"))


def confusion(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), cut: float = 0.5, strict: bool = False, eps: float = EPS, weight: str | None = None
) -> DataFrame:
    """Counts at a cut and the rates derived from them; a rate without a base is NULL.

    ``strict`` counts only p > cut as a positive call.  With a ``weight`` the counts are sums of weights.
    """
    called = F.col(p) > cut if strict else F.col(p) >= cut
    actual = F.col(y) == 1

    def cell(c: Column, name: str) -> Column:
        if weight:
            return F.coalesce(F.sum(F.when(c, row_weight(weight))), F.lit(0.0)).alias(name)
        return F.count(F.when(c, 1)).alias(name)

    counts = df.groupBy(*by).agg(
        cell(called & actual, "tp"),
        cell(~called & ~actual, "tn"),
        cell(called & ~actual, "fp"),
        cell(~called & actual, "fn"),
        weighted_mean(log_loss_term(F.col(y), F.col(p), eps), weight).alias("log_loss"),
    )
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    accuracy = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return counts.withColumns(
        {
            "sensitivity": F.try_divide(tp, tp + fn),
            "specificity": F.try_divide(tn, tn + fp),
            "npv": F.try_divide(tn, tn + fn),
            "precision": F.try_divide(tp, tp + fp),
            "accuracy": accuracy,
            "kappa": F.try_divide(accuracy - chance, F.lit(1.0) - chance),
        }
    )


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rank AUC with ties at mid-rank; higher score means positive. NULL if a class is absent.

    With a ``weight`` a pair of rows counts as often as the product of their weights.
    """
    by = list(by)
    if weight:
        w = row_weight(weight)
        counts = ranked_counts(df, p, by, {"pos": F.when(F.col(y) == 1, w).otherwise(0.0), "all": w}, running="all")
        below = F.col("cum") - F.col("all")
        neg = F.col("all") - F.col("pos")
        # Negatives below a value are all rows below it less the positives below it.
        sums = counts.groupBy(*by).agg(
            F.sum(F.col("pos") * (below + F.col("all") / 2.0)).alias("rank_sum"),
            F.sum("pos").alias("n1"),
            F.sum(neg).alias("n0"),
        )
        n1, n0 = F.col("n1"), F.col("n0")
        return sums.select(*by, F.try_divide(F.col("rank_sum") - n1 * n1 / 2.0, n1 * n0).alias("auc"))
    counts = ranked_counts(df, p, by, {"pos": (F.col(y) == 1).cast("bigint")})
    mid_rank = F.col("cum") - F.col("cnt") + (F.col("cnt") + 1) / 2.0
    sums = counts.groupBy(*by).agg(
        F.sum(F.col("pos") * mid_rank).alias("rank_sum"),
        F.sum("pos").cast("double").alias("n1"),
        F.sum(F.col("cnt") - F.col("pos")).cast("double").alias("n0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    area = F.try_divide(F.col("rank_sum") - n1 * (n1 + 1) / 2.0, n1 * n0)
    return sums.select(*by, area.alias("auc"))


def score_models(
    preds: DataFrame, y: str = "label", p: str = "p", model: str = "model", cut: float = 0.5, weight: str | None = None
) -> DataFrame:
    """Log-loss, confusion rates and AUC, one row per model."""
    return confusion(preds, y, p, [model], cut, weight=weight).join(auc(preds, y, p, [model], weight), model, "left")


def prediction_matrix(preds: DataFrame, models: Sequence[str], row_id: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row per row id, one column per model; the models are given, so no extra pass finds them."""
    return preds.groupBy(row_id, *keep).pivot("model", list(models)).agg(F.first("p"))


def blend(preds: DataFrame, weights: Mapping[str, float], row_id: str = "row_id", keep: Sequence[str] = (), name: str = "ensemble") -> DataFrame:
    """Weighted mean probability per row as a further model; NULL where a model gave none."""
    table = F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, float(w))])
    used = preds.where(F.col("model").isin(list(weights)))
    total = F.sum(F.col("p") * F.element_at(table, F.col("model")))
    mixed = used.groupBy(row_id, *keep).agg(F.when(F.count("p") == len(weights), total).alias("p"))
    return mixed.select(row_id, *keep, F.lit(name).alias("model"), "p")


def proportional_reduction(scores: DataFrame, base: str = "null", metric: str = "log_loss") -> DataFrame:
    """Share of the base model's loss that each model removes."""
    at = scores.where(F.col("model") == base).select(metric).scalar()
    return scores.withColumn("reduction", F.abs((F.col(metric) - at) / at))


def leaderboard(scores: DataFrame, labels: DataFrame, digits: int = 3, metric: str = "log_loss") -> DataFrame:
    """Display names, rounded numbers, best first. ``seconds`` is shown as ``minutes``."""
    named = scores.join(bounded(labels).select("model", F.col("label").alias("__label")), "model", "left")
    named = named.withColumn("model", F.coalesce("__label", "model")).drop("__label")
    if "seconds" in named.columns:
        named = named.withColumn("minutes", F.col("seconds") / 60).drop("seconds")
    order = named.orderBy(metric)
    numeric = [f.name for f in named.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return order.withColumns({c: F.round(c, digits) for c in numeric})


def unit_risk(
    preds: DataFrame, unit: str, period: str, p: str = "p", replicate: str | Sequence[str] = (), eps: float = EPS
) -> DataFrame:
    """Probability that a unit meets at least one event in a period.

    One minus the product of (1 - p) over the directed pairs that target it, as a sum of
    logarithms, averaged over the replicates.
    """
    reps = [replicate] if isinstance(replicate, str) else list(replicate)
    none = F.sum(F.log1p(-F.least(F.col(p), F.lit(1.0 - eps))))
    risk = preds.groupBy(unit, period, *reps).agg((F.lit(1.0) - F.exp(none)).alias("risk"), F.count(F.lit(1)).alias("n_pairs"))
    if not reps:
        return risk
    return risk.groupBy(unit, period).agg(F.avg("risk").alias("risk"), F.max("n_pairs").alias("n_pairs"))
