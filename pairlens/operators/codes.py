"""Code conformance and group-level filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import bounded


def canonical_code(code: Column) -> Column:
    """Numeric or textual code to its canonical text: no padding, no blanks, NULL if not a number."""
    return F.trim(code.cast("string")).try_cast("decimal(20,0)").cast("string")


def display_key(*parts: Column) -> Column:
    """``a_b_c`` text key; NULL if any part is NULL."""
    pieces = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit("_"))
        pieces.append(p.cast("string"))
    return F.concat(*pieces)


def conform_codes(
    df: DataFrame,
    code_cols: Sequence[str] | str,
    period_col: str,
    mapping: DataFrame,
    drop_invalid: bool = True,
    key_name: str | None = None,
    normalize: bool = False,
) -> DataFrame:
    """Map (code, period) to the canonical code through validity intervals.

    ``mapping`` has ``raw_code, valid_from, valid_to, canonical_code``; its
    intervals must not overlap per code.  A code without a matching interval
    becomes NULL, and with ``drop_invalid`` its row goes.  ``normalize`` brings the codes
    of both tables to canonical text first.  The join is an equi
    join on the code with the interval as residual.  A mapping of checked small
    size is broadcast, so a code that most rows carry does not gather them.
    """
    cols = [code_cols] if isinstance(code_cols, str) else list(code_cols)
    out, order = df, df.columns
    if normalize:
        mapping = mapping.withColumns({c: canonical_code(F.col(c)) for c in ("raw_code", "canonical_code")})
        out = out.withColumns({c: canonical_code(F.col(c)) for c in cols})
    mapping = bounded(mapping)
    how = "inner" if drop_invalid else "left"
    for c in cols:
        side = mapping.select(
            F.col("raw_code").alias("__raw"),
            F.col("valid_from").alias("__from"),
            F.col("valid_to").alias("__to"),
            F.col("canonical_code").alias("__canonical"),
        )
        if drop_invalid:
            side = side.where(F.col("__canonical").isNotNull())
        matched = (F.col(c) == F.col("__raw")) & F.col(period_col).between(F.col("__from"), F.col("__to"))
        out = out.join(side, matched, how).withColumn(c, F.col("__canonical")).select(*order)
    if key_name:
        out = out.withColumn(key_name, display_key(*[F.col(c) for c in cols], F.col(period_col)))
    return out


# Parts that the time of the data is cut into for an interval join, and clashing intervals that are shown.
TIME_PARTS, CLASHES = 64, 5


def _cut(mapping: DataFrame, first: int, width: int, last: int) -> DataFrame:
    """Each interval once for every part of the data's time that it touches."""
    low, high = F.greatest(F.col("__from"), F.lit(first)), F.least(F.col("__to"), F.lit(last))
    part = lambda t: F.floor((t - F.lit(first)) / F.lit(width)).cast("int")
    return mapping.where(low <= high).withColumn("__part", F.explode(F.sequence(part(low), part(high))))


def overlapping_intervals(mapping: DataFrame) -> DataFrame:
    """Intervals of a cut mapping that begin before an earlier one of their code has ended.

    Intervals that overlap share a part of time, so a running maximum of the ends inside code
    and part finds all of them.
    """
    before = W.partitionBy("__raw", "__part").orderBy("__from", "__to").rowsBetween(W.unboundedPreceding, -1)
    return mapping.withColumn("__reach", F.max("__to").over(before)).where(F.col("__from") <= F.col("__reach"))


def conform_by_intervals(
    df: DataFrame, code: str, period: str, mapping: DataFrame, drop_invalid: bool = True, parts: int = TIME_PARTS
) -> DataFrame:
    """``conform_codes`` for mappings of any size, joined on code and part of time, without a broadcast.

    The time of the data is cut into ``parts``; an interval is repeated for each part it touches,
    at most ``parts`` times, and the rows of a very common code are spread over the parts.
    Intervals of a code that overlap within the time of the data raise an error that shows some of
    them, since rows would be multiplied.  Intervals without an end or that end before they
    begin match nothing; a null canonical code counts as no match.
    """
    first, last = df.agg(F.min(period), F.max(period)).first()
    if first is None:
        return df.where("false") if drop_invalid else df.withColumn(code, F.lit(None).cast(mapping.schema["canonical_code"].dataType)).select(*df.columns)
    first, last = int(first), int(last)
    width = (last - first) // parts + 1
    side = mapping.select(
        F.col("raw_code").alias("__raw"), F.col("valid_from").cast("long").alias("__from"), F.col("valid_to").cast("long").alias("__to"),
        F.col("canonical_code").alias("__canonical"),
    )
    side = _cut(side, first, width, last)
    clashes = overlapping_intervals(side).limit(CLASHES).collect()
    if clashes:
        shown = "; ".join(f"{r['__raw']}: {r['__from']} to {r['__to']} after {r['__reach']}" for r in clashes)
        raise ValueError(f"intervals overlap: {shown}")
    rows = df.withColumn("__part", F.floor((F.col(period) - F.lit(first)) / F.lit(width)).cast("int"))
    side = side.where(F.col("__canonical").isNotNull()).withColumnRenamed("__part", "__in").hint("merge")
    matched = (F.col(code) == F.col("__raw")) & (F.col("__part") == F.col("__in")) & F.col(period).between(F.col("__from"), F.col("__to"))
    joined = rows.join(side, matched, "inner" if drop_invalid else "left")
    return joined.withColumn(code, F.col("__canonical")).select(*df.columns)


def group_filter(
    df: DataFrame, key: Sequence[str] | str, any_: Column | None = None, none_: Column | None = None
) -> DataFrame:
    """Keep the groups in which some row meets ``any_`` and no row meets ``none_``.

    The conditions are combined per key before the shuffle and the rows are then
    semi-joined, so a key that holds a large part of the rows is never gathered
    in one sorted window group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tests, keep = [], F.lit(True)
    if any_ is not None:
        tests.append(F.max(F.coalesce(any_, F.lit(False))).alias("__any"))
        keep = keep & F.col("__any")
    if none_ is not None:
        tests.append(F.max(F.coalesce(none_, F.lit(False))).alias("__none"))
        keep = keep & ~F.col("__none")
    if not tests:
        return df
    return df.join(df.groupBy(*keys).agg(*tests).where(keep).select(*keys), keys, "left_semi").select(*df.columns)
