"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Abramowitz and Stegun, formula 7.1.26 (error below 7e-8 for Phi).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function as a Column expression."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(z) / F.sqrt(F.lit(2.0)))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.lit(0.5) * (F.lit(1.0) + F.signum(z) * (F.lit(1.0) - poly * F.exp(-z * z / F.lit(2.0))))


def asinh_odd(x: Column) -> Column:
    """asinh that is symmetric for large negative input (the built-in gives -inf there)."""
    return F.signum(x) * F.asinh(F.abs(x))


def flag(condition: Column) -> Column:
    """0/1 flag that stays NULL where the condition is unknown."""
    return condition.cast("int")


def in_set(col: Column, values: Iterable) -> Column:
    """Set membership that is FALSE, not NULL, for a NULL value."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def md5_key(seed: int | str, *ids: Column) -> Column:
    """Hex digest of ``seed:id[:id..]``; the same text gives the same digest in any SQL engine."""
    parts = [F.lit(str(seed))]
    for c in ids:
        parts += [F.lit(":"), c.cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def seeded_draw(seed: int | str, *ids: Column) -> Column:
    """Reproducible integer draw in [0, 2^60) from the leading 15 hex digits of the digest."""
    return F.conv(F.substring(md5_key(seed, *ids), 1, 15), 16, 10).cast("bigint")


def seeded_uniform(seed: int | str, *ids: Column) -> Column:
    """Reproducible uniform draw in [0, 1)."""
    return seeded_draw(seed, *ids) / F.lit(float(1 << 60))


def mask_draw(seed: int | str, percent: int, *ids: Column) -> Column:
    """TRUE for about ``percent`` percent of the keys."""
    return seeded_draw(seed, *ids) % F.lit(100) < F.lit(percent)
