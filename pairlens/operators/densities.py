"""Kernel densities of features per class, and the naive Bayes classifier on them.

Values are binned linearly on a fixed grid (each adds to its two neighbours), so one pass of
counts stands for all rows; the grid is then smoothed with a normal kernel.  Published rule of
the bandwidth: Silverman (1986), 0.9 min(sd, IQR / 1.34) n^(-1/5).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bounded, exact_quantiles

#: Bandwidths that a grid reaches beyond the smallest and the largest value, and the least density that counts.
REACH, LEAST = 3.0, 1e-12


def kernel_grids(cells: DataFrame, by: Sequence[str], value: str = "value", points: int = 128, adjust: float = 1.0) -> DataFrame:
    """``by, n, low, step, width, density``: a density on ``points`` grid points for every group.

    ``width`` is the bandwidth, ``density`` the array of values at ``low + step * i``.  Null values do
    not count.  A group of one distinct value gets the bandwidth ``adjust``.
    """
    by = list(by)
    cells = cells.where(F.col(value).isNotNull())
    spread = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    quartiles = exact_quantiles(cells, value, {"q1": 0.25, "q3": 0.75}, by)
    sd = F.coalesce(F.nanvl("sd", F.lit(0.0)), F.lit(0.0))
    least = F.least(sd, (F.col("q3") - F.col("q1")) / 1.34)
    scale = F.when(least > 0, least).when(sd > 0, sd)
    width = F.coalesce(F.lit(0.9 * adjust) * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(float(adjust)))
    heads = spread.join(quartiles, by).withColumn("width", width)
    heads = heads.withColumn("low", F.col("lowest") - REACH * F.col("width"))
    heads = heads.withColumn("step", (F.col("highest") + REACH * F.col("width") - F.col("low")) / (points - 1))
    # One row per group: classes times features.
    heads = bounded(heads.select(*by, "n", "low", "step", "width"))
    at = (F.col(value) - F.col("low")) / F.col("step")
    k = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    parts = F.array(F.struct(k.alias("__bin"), (F.lit(1.0) - (at - k)).alias("__v")), F.struct((k + 1).alias("__bin"), (at - k).alias("__v")))
    binned = cells.join(heads, by).select(*by, F.inline(parts)).groupBy(*by, "__bin").agg(F.sum("__v").alias("__v"))
    counts = binned.groupBy(*by).agg(F.collect_list(F.struct("__bin", "__v")).alias("bins"))

    def smooth(j: Column) -> Column:
        z = lambda b: (j - b["__bin"]) * F.col("step") / F.col("width")
        total = F.aggregate("bins", F.lit(0.0), lambda s, b: s + b["__v"] * F.exp(-z(b) * z(b) / 2))
        return total / (F.col("n") * F.col("width") * F.lit(2.5066282746310002))

    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), smooth)
    # Bins come in any order; sorted, they add up in the same one every time.
    return counts.withColumn("bins", F.array_sort("bins")).join(heads, by).select(*by, "n", "low", "step", "width", grid.alias("density"))


def density_at(x: Column, low: float, step: float, density: Sequence[float]) -> Column:
    """Linear interpolation on a grid, at least ``LEAST``; beyond the grid the density is ``LEAST``."""
    values = F.array(*[F.lit(float(d)) for d in density])
    at = (x - F.lit(low)) / F.lit(step)
    k = F.least(F.floor(at), F.lit(len(density) - 2)).cast("int")
    inside = F.get(values, k) * (F.lit(1.0) - (at - k)) + F.get(values, k + 1) * (at - k)
    return F.greatest(F.when((at >= 0) & (at <= len(density) - 1), inside).otherwise(F.lit(LEAST)), F.lit(LEAST))


def fit_kernel_bayes(train: DataFrame, params: Mapping, seed: int):
    """A scorer for two classes: the product of the features' densities in each class and its share."""
    weight = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    shares = dict(train.groupBy("label").agg(F.sum(weight)).collect())
    rows = train
    if "weight" in train.columns:
        rows = train.withColumn("__c", F.explode(F.array_repeat(F.lit(1), F.col("weight").cast("int"))))
    cells = rows.select("label", F.posexplode(vector_to_array("features")).alias("feature", "value"))
    grids = kernel_grids(cells, ["label", "feature"], points=int(params.get("points", 128)), adjust=float(params.get("adjust", 1.0))).collect()
    total = sum(shares.values())

    def log_density(label: float, x: Column) -> Column:
        out = F.lit(0.0) + F.log(F.lit(max(shares.get(label, 0.0) / total, LEAST)))
        for g in grids:
            if g["label"] == label:
                out = out + F.log(density_at(F.get(x, g["feature"]), g["low"], g["step"], g["density"]))
        return out

    def score(df: DataFrame) -> DataFrame:
        both = df.withColumn("__x", vector_to_array("features"))
        both = both.withColumn("__d", log_density(0.0, F.col("__x")) - log_density(1.0, F.col("__x")))
        return both.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.col("__d"), F.lit(700.0))))).drop("__x", "__d")

    return score
