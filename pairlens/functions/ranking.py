"""Global ranks without a one-task window.

A window without PARTITION BY (or partitioned by a class that holds most rows)
sorts everything in one task.  Both helpers below cut the order into buckets
first, count the buckets, and run the window inside each bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .bounded import bounded
from .expressions import md5_key

# Distinct values one sorted group may hold before its range is cut into buckets.
BUCKET_VALUES = 1_000_000
MAX_BUCKETS = 4096
MAX_SPLITS = 2_000_000
MIN_BUCKETS = 16


def _range_splits(df: DataFrame, value: str, by: Sequence[str], bucket_values: int) -> list:
    """Split points of every group that is too large for one sorted group.

    One scan with partial aggregation.  The collected rows are bounded: a group
    only appears if it has more than ``bucket_values`` distinct values.  They
    are collected so that every later stage, and any re-run of a lost task, sees
    the same split points.
    """
    if not by:
        # Without a group there is nothing else to deal the values by, so they are always cut.
        n = df.agg(F.approx_count_distinct(value)).first()[0]
        buckets = max(MIN_BUCKETS, min(MAX_BUCKETS, int(n // bucket_values) + 1))
        probs = [i / buckets for i in range(1, buckets)]
        splits = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 10 * buckets)).first()[0]
        return [{"splits": sorted(set(splits))}] if splits else []
    sizes = df.groupBy(*by).agg(F.approx_count_distinct(value).alias("n"))
    # Broadcast, else the join below would bring all rows of a group together in one task.
    large = bounded(sizes.where(F.col("n") > bucket_values))
    top, groups = large.agg(F.max("n"), F.count(F.lit(1))).first()
    if top is None:
        return []
    # The split table stays below MAX_SPLITS numbers whatever the number of large groups.
    buckets = max(2, min(MAX_BUCKETS, int(top // bucket_values) + 1, MAX_SPLITS // groups))
    probs = [i / buckets for i in range(1, buckets)]
    keyed = df.join(large.select(*by), list(by), "left_semi")
    splits = keyed.groupBy(*by).agg(
        F.percentile_approx(F.col(value).cast("double"), probs, 10 * buckets).alias("splits")
    )
    return splits.collect()


def ranked_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
    bucket_values: int = BUCKET_VALUES,
    running: str = "cnt",
) -> DataFrame:
    """Distinct non-null values per group with counts and running counts.

    Columns: ``by``, ``value``, ``cnt``, ``cum`` (rows with value <= this one) and
    the ``extra`` sums per distinct value; ``running`` names the one that ``cum`` adds up.  ``by`` is a small set of labels
    (variable names, model names), any of which may hold most of the rows.
    """
    by = list(by)
    data = df.where(F.col(value).isNotNull())
    splits = _range_splits(data, value, by, bucket_values)
    sums = [F.sum(c).alias(n) for n, c in (extra or {}).items()]
    counts = data.groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"), *sums)
    if not splits and not by:  # no values at all
        return counts.withColumn("cum", F.col(running))
    if not splits:
        window = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
        return counts.withColumn("cum", F.sum(running).over(window))

    if by:
        fields = [f for f in df.select(*by).schema.fields]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["splits array<double>"])
        table = df.sparkSession.createDataFrame([tuple(r) for r in splits], schema)
        # Built from collected rows, at most MAX_SPLITS numbers.
        placed = counts.join(F.broadcast(table), by, "left")
    else:
        placed = counts.withColumn("splits", F.array(*[F.lit(float(s)) for s in splits[0]["splits"]]))
    below = F.size(F.filter("splits", lambda s: s < F.col(value).cast("double")))
    placed = placed.withColumn("bucket", F.coalesce(below, F.lit(0))).drop("splits")
    totals = placed.groupBy(*by, "bucket").agg(F.sum(running).alias("bucket_cnt"))
    inside = W.partitionBy(*by, "bucket").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    if not by:
        # One number per bucket comes to the driver and goes back as an expression.
        starts, total = [], 0
        for bucket, n in sorted((r["bucket"], r["bucket_cnt"]) for r in totals.collect()):
            starts += [F.lit(bucket), F.lit(total)]
            total += n
        offset = F.element_at(F.create_map(*starts), F.col("bucket"))
        return placed.withColumn("cum", offset + F.sum(running).over(inside)).drop("bucket")
    before = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "bucket", F.coalesce(F.sum("bucket_cnt").over(before), F.lit(0)).alias("offset")
    )
    return (
        placed.join(offsets, [*by, "bucket"])
        .withColumn("cum", F.col("offset") + F.sum(running).over(inside))
        .drop("bucket", "offset")
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), bucket_values: int = BUCKET_VALUES
) -> DataFrame:
    """Exact interpolated quantiles (position ``q * (n - 1)``) per group, one column per name.

    The built-in ``percentile`` keeps every distinct value of a group in one
    aggregation buffer; this picks the two order statistics off the running counts.
    """
    by = list(by)
    counts = ranked_counts(df, value, by, bucket_values=bucket_values)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sized = counts.join(bounded(sizes), by) if by else counts.withColumn("n", sizes.scalar())
    x, start, end = F.col(value).cast("double"), F.col("cum") - F.col("cnt"), F.col("cum")
    picks = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        for side, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((start <= idx) & (idx < end), x)).alias(f"{name}_{side}"))
    picked = sized.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    cols = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*by, *cols)


def _hash_offsets(hashed: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each hash bucket, per class. One row per class and bucket, so bounded by the digits."""
    totals = hashed.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("bucket_cnt"))
    order = W.partitionBy(*by).orderBy("bucket")
    return totals.select(
        *by,
        "bucket",
        "bucket_cnt",
        F.coalesce(F.sum("bucket_cnt").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )


def hash_rank(
    df: DataFrame, row_id: str, by: Sequence[str], seed: int | str, name: str = "rank", digits: int = 4
) -> DataFrame:
    """Rank 1..n of every row within its class in seeded-md5 order.

    The digest spreads any class evenly over ``16 ** digits`` buckets, so the
    window sorts small groups even if one class holds nearly all rows.  Without classes
    the rows before each bucket are added up on the driver, ``16 ** digits`` numbers.
    """
    by = list(by)
    hashed = df.withColumn("hash", md5_key(seed, F.col(row_id))).withColumn("bucket", F.substring("hash", 1, digits))
    if not by:
        before, total = [], 0
        for bucket, n in sorted(tuple(r) for r in hashed.where("bucket IS NOT NULL").groupBy("bucket").count().collect()):
            before.append((bucket, total))
            total += n
        offsets = F.broadcast(df.sparkSession.createDataFrame(before, "bucket string, offset long"))
        ranked = hashed.withColumn("in_bucket", F.row_number().over(W.partitionBy("bucket").orderBy("hash", row_id))).join(offsets, "bucket")
        return ranked.withColumn(name, F.col("offset") + F.col("in_bucket")).drop("hash", "bucket", "in_bucket", "offset")
    offsets = _hash_offsets(hashed, by).drop("bucket_cnt")
    inside = W.partitionBy(*by, "bucket").orderBy("hash", row_id)
    return (
        hashed.withColumn("in_bucket", F.row_number().over(inside))
        .join(offsets, [*by, "bucket"])
        .withColumn(name, F.col("offset") + F.col("in_bucket"))
        .drop("hash", "bucket", "in_bucket", "offset")
    )


def hash_cutoff(
    df: DataFrame, row_id: str, by: Sequence[str], seed: int | str, share: float, digits: int = 4
) -> DataFrame:
    """Per class, the hash and id of row number ``ceil(share * n)`` in seeded-md5 order.

    Only the one bucket per class that holds the cutoff is ever sorted; the rest
    is counted.  The result has one row per class.
    """
    by = list(by)
    hashed = df.select(*by, row_id, md5_key(seed, F.col(row_id)).alias("hash")).withColumn(
        "bucket", F.substring("hash", 1, digits)
    )
    offsets = _hash_offsets(hashed, by)
    sized = offsets.withColumn("n", F.sum("bucket_cnt").over(W.partitionBy(*by)))
    wanted = F.ceil(F.lit(float(share)) * F.col("n").cast("double"))
    boundary = sized.withColumn("wanted", wanted).where(
        (F.col("offset") < F.col("wanted")) & (F.col("wanted") <= F.col("offset") + F.col("bucket_cnt"))
    )
    boundary = boundary.select(*by, "bucket", (F.col("wanted") - F.col("offset")).alias("nth"))
    inside = W.partitionBy(*by, "bucket").orderBy("hash", row_id)
    # One boundary bucket per class; with few classes the rows stay where they are.
    return (
        hashed.join(bounded(boundary), [*by, "bucket"])
        .withColumn("pos", F.row_number().over(inside))
        .where(F.col("pos") == F.col("nth"))
        .select(*by, F.col("hash").alias("cut_hash"), F.col(row_id).alias("cut_id"))
    )
