"""Scaling of skewed measures and the priors for missing cells before a first record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import asinh_odd, bounded, normal_cdf, ranked_counts

DEFAULT_EXPONENTS = range(-25, 26)


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def normal_distance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Largest gap between the empirical distribution and the fitted normal, per column.

    Right-limit form: the empirical distribution at x counts every row <= x.
    """
    cells = _long(df, cols)
    counts = ranked_counts(cells, "value", ["name"])
    fit = cells.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd")
    )
    gap = F.abs(F.col("cum") / F.col("n") - normal_cdf(F.try_divide(F.col("value") - F.col("mu"), F.col("sd"))))
    return counts.join(bounded(fit), "name").groupBy("name").agg(F.max(gap).alias("distance"))


def asinh_scale_search(
    df: DataFrame, cols: Sequence[str], exponents: Sequence[int] = DEFAULT_EXPONENTS, digits: int = 6
) -> DataFrame:
    """Per column the first scale 2^k that brings asinh(2^k x) closest to a normal.

    asinh is increasing, so all candidates share one empirical distribution: the
    values are ranked once and only the moments and the largest gap are computed
    per candidate, on distinct values with counts.
    """
    cells = _long(df, cols)
    counts = ranked_counts(cells, "value", ["name"])
    # One row per variable and candidate; the centre keeps the sums of squares well scaled.
    sizes = cells.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("centre"))
    exponent = F.explode(F.array(*[F.lit(int(k)) for k in exponents])).alias("exponent")
    grid = sizes.select("name", "n", "centre", exponent).withColumn("scale", F.pow(F.lit(2.0), F.col("exponent")))
    grid = bounded(grid.withColumn("shift", asinh_odd(F.col("scale") * F.col("centre"))).drop("centre"))
    # Ranking leaves a variable's values in few partitions; the candidates multiply the work,
    # so the values are spread over all tasks first.
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tried = counts.repartition(spread, "name", "value").join(grid, "name")
    moved = tried.withColumn("y", asinh_odd(F.col("scale") * F.col("value")) - F.col("shift"))
    moments = moved.groupBy("name", "exponent").agg(
        F.sum(F.col("cnt") * F.col("y")).alias("s1"),
        F.sum(F.col("cnt") * F.col("y") * F.col("y")).alias("s2"),
        F.max("n").alias("total"),
    )
    mu = F.col("s1") / F.col("total")
    var = F.try_divide(F.greatest(F.col("s2") - F.col("s1") * mu, F.lit(0.0)), F.col("total") - 1)
    moments = moments.select("name", "exponent", mu.alias("mu"), F.sqrt(var).alias("sd"))
    gap = F.abs(F.col("cum") / F.col("n") - normal_cdf(F.try_divide(F.col("y") - F.col("mu"), F.col("sd"))))
    scored = moved.join(bounded(moments), ["name", "exponent"]).groupBy("name", "exponent").agg(
        F.max(gap).alias("distance")
    )
    best = F.min(F.struct(F.round("distance", digits).alias("distance"), "exponent")).alias("best")
    return scored.groupBy("name").agg(best).select(
        "name", F.col("best.exponent").alias("exponent"), F.col("best.distance").alias("distance")
    )


def asinh_scale(df: DataFrame, theta: Mapping[str, float]) -> DataFrame:
    """Apply asinh(s x) with one scale per column."""
    return df.withColumns({c: asinh_odd(F.lit(float(s)) * F.col(c)) for c, s in theta.items()})


def last_all_zero(df: DataFrame, unit: Sequence[str] | str, period: str, cols: Sequence[str]) -> DataFrame:
    """Latest period at which the running sum of the non-null series is still zero; NULL if none.

    The window runs over one unit's periods (one row each).
    """
    units = [unit] if isinstance(unit, str) else list(unit)
    so_far = W.partitionBy(*units).orderBy(period).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = df.select(*units, period, *cols, *[F.sum(c).over(so_far).alias(f"__run_{c}") for c in cols])
    zero = [
        F.max(F.when(F.col(c).isNotNull() & (F.col(f"__run_{c}") == 0), F.col(period))).alias(c) for c in cols
    ]
    return running.groupBy(*units).agg(*zero)


def zero_priors(
    df: DataFrame, laz: DataFrame, row_id: str, unit: Sequence[str] | str, period: str, cols: Sequence[str]
) -> DataFrame:
    """Prior rows ``(row_id, name, mu, sigma)`` for cells missing before the last all-zero period."""
    units = [unit] if isinstance(unit, str) else list(unit)
    limits = laz.select(*units, *[F.col(c).alias(f"__laz_{c}") for c in cols])
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    joined = df.select(row_id, *units, period, *cols).join(limits, units)
    cells = [
        F.struct(
            F.lit(c).alias("name"),
            (F.col(c).isNull() & (F.col(period) < F.col(f"__laz_{c}"))).alias("wanted"),
        )
        for c in cols
    ]
    sds = spread.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("sigma")) for c in cols])))
    wanted = joined.select(row_id, F.inline(F.array(*cells))).where("wanted").drop("wanted")
    return wanted.join(bounded(sds), "name").select(row_id, "name", F.lit(0.0).alias("mu"), "sigma")
