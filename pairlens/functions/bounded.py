"""Small tables handed to every task, only after their size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import AtomicType, StringType

MAX_BYTES = 8 << 20
# Bytes that a value takes at least, by which the rows that may come to the driver are limited.
VALUE_BYTES, TEXT_BYTES, NESTED_BYTES = 8, 16, 64


def bounded(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` as a broadcast table if its rows take at most ``max_bytes``, else ``df`` itself.

    The check runs ``df`` once and keeps its rows, so a small summary is not computed
    again by the join; a large one is left to an ordinary shuffle join.  No more rows are
    fetched than could fit, and what they take as text is added up.
    """
    kinds = [f.dataType for f in df.schema.fields]
    width = sum(TEXT_BYTES if isinstance(k, StringType) else VALUE_BYTES if isinstance(k, AtomicType) else NESTED_BYTES for k in kinds)
    most = max_bytes // max(width, 1)
    sized = df.select(F.struct("*").alias("row"), F.length(F.to_json(F.struct("*"))).alias("bytes"))
    rows = sized.limit(most + 1).collect()
    if len(rows) > most or sum(r["bytes"] or 0 for r in rows) > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame([r["row"] for r in rows], df.schema))
