"""Joins on keys that may be very common, without sending all their rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A key with this share of the rows is hot; there are 1 / HOT_SHARE such keys at most.
HOT_SHARE = 1 / 2048


def join_counted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """``rows`` joined with ``keyed``, which has each key once with the number of rows that hold it, ``count`` (dropped).

    Hot keys are broadcast, which their share of all rows bounds; their rows stay where they are.
    The others meet in an ordinary join, where no key gathers more than ``HOT_SHARE`` of the rows.
    Both tables should be stored, as they are read twice.
    """
    limit = max(1, int(rows.count() * HOT_SHARE))
    hot = F.broadcast(keyed.where(F.col(count) >= limit).drop(count))
    cold = keyed.where(F.col(count) < limit).drop(count)
    common = rows.join(hot, list(keys))
    rest = rows.join(F.broadcast(keyed.where(F.col(count) >= limit).select(*keys)), list(keys), "left_anti").join(cold, list(keys))
    return common.unionByName(rest.select(common.columns))
