"""Cleaning, patching and audits of unit-period tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bounded


def _keys(key: Sequence[str] | str) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sentinel_to_null(df: DataFrame, cols: Sequence[str], sentinel: Any) -> DataFrame:
    """Replace a sentinel value by NULL in many columns at once."""
    return df.withColumns({c: F.when(F.col(c) != F.lit(sentinel), F.col(c)) for c in cols})


def recode_special(df: DataFrame, col: str, codes: Sequence, replacement_col: str) -> DataFrame:
    """Where ``col`` holds a special code take ``replacement_col`` instead."""
    return df.withColumn(col, F.when(F.col(col).isin(list(codes)), F.col(replacement_col)).otherwise(F.col(col)))


def expand_ranges(patch: DataFrame, start: str, end: str, period: str) -> DataFrame:
    """Literal patch rows given for period ranges, one row per period."""
    up = F.when(F.col(end) >= F.col(start), F.sequence(F.col(start), F.col(end)))
    return patch.withColumn(period, F.explode(up)).drop(start, end)


def patch_rows(df: DataFrame, patch: DataFrame, key: Sequence[str] | str, mode: str = "upsert") -> DataFrame:
    """Add literal rows. ``upsert`` replaces rows of the same key, ``append`` keeps both."""
    if mode not in ("append", "upsert"):
        raise ValueError(f"unknown mode {mode!r}")
    base = df.join(patch.select(*_keys(key)).distinct(), _keys(key), "left_anti") if mode == "upsert" else df
    return base.unionByName(patch, allowMissingColumns=True).select(*df.columns)


def clone_rows(
    df: DataFrame, where: Column, set_: Mapping[str, Column], key: Sequence[str] | str, mode: str = "upsert"
) -> DataFrame:
    """Copy the rows that match ``where`` under new values (another unit's code)."""
    return patch_rows(df, df.where(where).withColumns(dict(set_)), key, mode)


def patch_values(df: DataFrame, patch: DataFrame, key: Sequence[str] | str, cols: Sequence[str]) -> DataFrame:
    """Override cells from a patch table; a NULL in the patch leaves the cell alone."""
    renamed = patch.select(*_keys(key), *[F.col(c).alias(f"__patch_{c}") for c in cols])
    joined = df.join(renamed, _keys(key), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__patch_{c}"), F.col(c)) for c in cols}).select(*df.columns)


def drop_ineligible(df: DataFrame, rules: DataFrame, unit: str, period: str) -> DataFrame:
    """Remove the unit-periods covered by ``rules(unit, drop_from, drop_to)``; a NULL bound is open."""
    r = bounded(rules).select(
        F.col(unit).alias("__unit"), F.col("drop_from").alias("__from"), F.col("drop_to").alias("__to")
    )
    p = F.col(period)
    hit = (
        (F.col(unit) == F.col("__unit"))
        & (F.col("__from").isNull() | (p >= F.col("__from")))
        & (F.col("__to").isNull() | (p <= F.col("__to")))
    )
    return df.join(r, hit, "left_anti")


def fill_defaults(df: DataFrame, defaults: Mapping[str, Any], where: Column | None = None) -> DataFrame:
    """Replace NULL by a default, only where ``where`` holds if it is given."""
    out = {}
    for c, v in defaults.items():
        hole = F.col(c).isNull() if where is None else F.col(c).isNull() & F.coalesce(where, F.lit(False))
        out[c] = F.when(hole, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c))
    return df.withColumns(out)


def keep_first(df: DataFrame, key: Sequence[str] | str, order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``; the remaining columns break ties.

    A minimum over (order, row) structs combines before the shuffle, so a key
    with very many copies sends one candidate per task instead of all its rows.
    """
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    lead = [F.col(o) if isinstance(o, str) else o for o in order]
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(lead)], F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg(F.min(ranked).alias("m")).select(*keys, "m.row.*").select(*df.columns)


def duplicate_audit(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def coverage_audit(
    universe: DataFrame, other: DataFrame, key: Sequence[str] | str, unit: str, period: str, label: str | None = None
) -> DataFrame:
    """Unit-periods of the universe that are absent from ``other``, one summary row per unit."""
    missing = universe.join(other.select(*_keys(key)).distinct(), _keys(key), "left_anti")
    aggs = [
        F.min(period).alias("first_missing"),
        F.max(period).alias("last_missing"),
        F.count(F.lit(1)).alias("n_missing"),
    ]
    if label:
        aggs.insert(0, F.min_by(label, period).alias(label))
    return missing.groupBy(unit).agg(*aggs)


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Percent of missing cells per column: one aggregation pass, then one row per column."""
    names = list(cols or df.columns)
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names])
    pct = [F.struct(F.lit(c).alias("column"), (F.round(F.col(c), digits) * 100).alias("pct_missing")) for c in names]
    return shares.select(F.inline(F.array(*pct)))


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep fully observed rows."""
    return df.na.drop(subset=list(cols) if cols else None)
