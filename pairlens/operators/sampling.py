"""Splits, folds and resamples. Every random choice is an md5 draw on the row id,
so it does not depend on partitioning and a lost task repeats it exactly.  Rows need a
known class: complete cases come first."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import bounded, exact_quantiles, hash_cutoff, hash_rank, md5_key, seeded_draw

# Rows of a class whose draws are counted together, and draws a row from which on counts are drawn instead.
DRAW_BLOCK, MANY_DRAWS = 4096, 16


def stratified_split(
    df: DataFrame, target: str, share: float, seed: int | str, row_id: str, name: str = "in_split"
) -> DataFrame:
    """Mark ``ceil(share * n)`` rows of every class.

    The rows are never ranked: the class's cutoff digest is found first, and each
    row is compared with it where it stands.
    """
    cut = bounded(hash_cutoff(df, row_id, [target], seed, share))
    digest = md5_key(seed, F.col(row_id))
    marked = df.withColumn("__h", digest).join(cut, target)
    inside = (F.col("__h") < F.col("cut_hash")) | (
        (F.col("__h") == F.col("cut_hash")) & (F.col(row_id) <= F.col("cut_id"))
    )
    return marked.withColumn(name, inside).select(*df.columns, name)


def train_eval_test(
    df: DataFrame,
    target: str,
    row_id: str,
    train: float = 0.6,
    evaluation: float = 1 / 3,
    seeds: tuple[int, int] = (90210, 555),
    name: str = "part",
) -> DataFrame:
    """Three disjoint parts: ``train`` of all rows, then ``evaluation`` of the rest, then the vault."""
    first = stratified_split(df, target, train, seeds[0], row_id, "__train")
    rest = first.where(~F.col("__train"))
    cut = bounded(hash_cutoff(rest, row_id, [target], seeds[1], evaluation))
    digest = md5_key(seeds[1], F.col(row_id))
    marked = first.withColumn("__h", digest).join(cut, target, "left")
    in_eval = (F.col("__h") < F.col("cut_hash")) | (
        (F.col("__h") == F.col("cut_hash")) & (F.col(row_id) <= F.col("cut_id"))
    )
    part = F.when(F.col("__train"), "train").when(F.coalesce(in_eval, F.lit(False)), "eval").otherwise("test")
    return marked.withColumn(name, part).select(*df.columns, name)


def assign_folds(df: DataFrame, k: int, seed: int | str, target: str, row_id: str, name: str = "fold") -> DataFrame:
    """Stratified fold ids 0..k-1: rank in md5 order within the class, modulo k."""
    ranked = hash_rank(df, row_id, [target], seed, "__rank")
    return ranked.withColumn(name, F.pmod(F.col("__rank"), F.lit(k)).cast("int")).select(*df.columns, name)


def class_sizes(df: DataFrame, target: str, max_classes: int = 10_000) -> dict:
    rows = df.groupBy(target).count().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{target} has more than {max_classes} classes")
    return {r[0]: r[1] for r in rows}


def draw_counts(
    df: DataFrame, target: str, draws: dict, seed: int | str, row_id: str, sizes: dict | None = None
) -> DataFrame:
    """Bootstrap as weights: ``row_id`` and how often each drawn row was drawn.

    ``draws`` maps a class to its number of draws with replacement.  Draw i of a class
    takes the row at position ``md5(seed:class:i) mod class size``, positions being the
    md5 order of the class.  Draws are counted before they meet the rows.
    """
    spark = df.sparkSession
    sizes = sizes or class_sizes(df, target)
    drawn = None
    for value, n in draws.items():
        if n <= 0 or not sizes.get(value):
            continue
        index = seeded_draw(f"{seed}:{value}", F.col("id")) % F.lit(sizes[value])
        part = spark.range(int(n)).select(F.lit(value).alias(target), (index + 1).alias("__rank"))
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        raise ValueError("nothing to draw")
    counted = drawn.groupBy(target, "__rank").agg(F.count(F.lit(1)).alias("n_draws"))
    ranked = hash_rank(df.select(row_id, target), row_id, [target], seed, "__rank")
    counted = counted.withColumn(target, F.col(target).cast(df.schema[target].dataType))
    return ranked.join(counted, [target, "__rank"]).select(row_id, "n_draws")


def block_draws(draws: np.ndarray, size: int, block: int, seed: int | str) -> np.ndarray:
    """How often each row of a block is drawn (fits x rows), where fit f draws ``draws[f]`` of ``size`` rows with replacement.

    The blocks of ``DRAW_BLOCK`` rows are halved until this one is left.  At each halving a binomial
    draw says how many draws of each fit fall into the lower half; its seed is the place of the halving
    alone, so all blocks agree on it, each is found by itself, and together they hold every draw once.
    """
    low, high, n = 0, -(-size // DRAW_BLOCK), np.asarray(draws, dtype=np.int64)
    rows = lambda a, b: min(b * DRAW_BLOCK, size) - a * DRAW_BLOCK
    rng = lambda: np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{low}:{high}".encode()).digest(), "big"))
    while high - low > 1:
        mid = (low + high) // 2
        below = rng().binomial(n, rows(low, mid) / rows(low, high))
        if block < mid:
            n, high = below, mid
        else:
            n, low = n - below, mid
    mine, random = rows(low, high), rng()
    even, out = np.full(mine, 1.0 / mine), np.empty((len(n), mine), dtype=np.int64)
    for f, k in enumerate(n):
        out[f] = random.multinomial(k, even) if k > MANY_DRAWS * mine else np.bincount(random.integers(0, mine, k, dtype=np.int32), minlength=mine)
    return out


def resample(
    df: DataFrame,
    target: str,
    seed: int | str,
    row_id: str,
    ratio: float = 100,
    positive=1,
    negative=0,
    as_weights: bool = False,
) -> DataFrame:
    """All-positives-sized bootstrap of the positives plus ``ratio`` times as many negatives.

    ``as_weights`` keeps one row per drawn row with its count ``n_draws``, which is what
    a weighted fit needs; otherwise the rows are repeated.
    """
    sizes = class_sizes(df, target)
    n_pos = sizes.get(positive, 0)
    draws = {positive: n_pos, negative: int(n_pos * ratio)}
    counted = draw_counts(df, target, draws, seed, row_id, sizes)
    out = df.join(counted, row_id)
    if as_weights:
        return out
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n_draws")))).drop("__copy", "n_draws")


def curve_summary(df: DataFrame, by: str | Sequence[str], metric: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean, standard error and two exact quantiles of a metric per group."""
    keys = [by] if isinstance(by, str) else list(by)
    stats = df.groupBy(*keys).agg(
        F.avg(metric).alias("mean"),
        (F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("se"),
        F.count(metric).alias("n"),
    )
    return stats.join(exact_quantiles(df, metric, {"lower": low, "upper": high}, keys), keys)
