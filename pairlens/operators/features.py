"""The model frame: derived features, dummies, label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import flag


def derive_features(
    df: DataFrame,
    joint: Mapping[str, tuple[str, str, float]] | None = None,
    logs: Sequence[str] = (),
    powers: Mapping[str, Sequence[tuple[int, float]]] | None = None,
    target: str | None = None,
    labels: tuple[str, str] = ("no", "yes"),
    drop: Sequence[str] = (),
    lead: Sequence[str] = (),
    prefixes: Sequence[str] = ("A_", "B_", "ud_"),
    where: Column | None = None,
) -> DataFrame:
    """Derived columns, then the final column set and order.

    ``joint={"both": ("A_x", "B_x", 6)}`` flags both sides at or over a threshold (NULL if
    unknown); ``logs`` are replaced by their logarithm; ``powers={"t": [(2, 100)]}`` adds
    ``t2 = t^2 / 100``.  The 0/1 ``target`` becomes a label text.
    """
    out = df if where is None else df.where(where)
    new: dict[str, Column] = {}
    for name, (a, b, cut) in (joint or {}).items():
        new[name] = flag((F.col(a) >= cut) & (F.col(b) >= cut))
    for c in logs:
        new[c] = F.ln(F.col(c))
    for c, terms in (powers or {}).items():
        for k, scale in terms:
            new[f"{c}{k}"] = F.pow(F.col(c).cast("double"), F.lit(k)) / F.lit(float(scale))
    if target:
        new[target] = F.when(F.col(target) == 1, labels[1]).when(F.col(target) == 0, labels[0])
    out = out.withColumns(new) if new else out
    kept = [c for c in out.columns if c not in set(drop)]
    head = [*lead, *([target] if target else [])]
    ordered = list(head)
    for p in prefixes:
        ordered += [c for c in kept if c.startswith(p) and c not in ordered]
    ordered += [c for c in kept if c not in ordered]
    return out.select(*ordered)


def dummy_encode(df: DataFrame, cat: str, levels: Sequence[str], drop: bool = True) -> DataFrame:
    """Treatment coding with the first level as reference; an unknown value stays NULL."""
    known = F.col(cat).isin(list(levels))
    out = df.withColumns(
        {f"{cat}_{v}": F.when(known, flag(F.col(cat) == v)) for v in list(levels)[1:]}
    )
    return out.drop(cat) if drop else out


BYTES = np.arange(256)
BLANKS, DIGITS, CAPITALS = np.isin(BYTES, list(b" \t\n\x0b\f\r")), np.isin(BYTES, list(b"0123456789")), (BYTES >= ord("A")) & (BYTES <= ord("Z"))


def count_characters(texts: pa.Array) -> pa.Array:
    """``blanks`` (runs of ASCII white space), ``breaks`` (newlines), ``digits`` and ``capitals`` (A-Z) of every text; null texts: null.

    Bytes are looked at, which is exact as UTF-8 uses none of these within other characters.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    blank = BLANKS[data]
    runs = blank.copy()
    runs[1:] &= ~blank[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    runs[first] = blank[first]
    null = texts.is_null().to_numpy(zero_copy_only=False)
    marked = {"blanks": runs, "breaks": data == ord("\n"), "digits": DIGITS[data], "capitals": CAPITALS[data]}
    counts = [pa.array(np.diff(np.searchsorted(np.flatnonzero(m), ends)), pa.int64(), mask=null) for m in marked.values()]
    return pa.StructArray.from_arrays(counts, names=list(marked))


character_counts = F.arrow_udf(count_characters, T.StructType([T.StructField(c, T.LongType()) for c in ("blanks", "breaks", "digits", "capitals")]))


def model_frame(df: DataFrame, row_id: str, label: Column, features: Sequence[str], weight: str | None = None) -> DataFrame:
    """``row_id, label, features[, weight]`` as the fits expect them."""
    cols = [F.col(row_id).alias("row_id"), label.cast("double").alias("label")]
    cols += [F.col(c).cast("double").alias(c) for c in features]
    if weight:
        cols.append(F.col(weight).cast("double").alias("weight"))
    packed = VectorAssembler(inputCols=list(features), outputCol="features").transform(df.select(*cols))
    return packed.select("row_id", "label", "features", *(["weight"] if weight else []))


def hinge_features(df: DataFrame, knots: Mapping[str, Sequence[float]]) -> DataFrame:
    """Mirrored hinge columns max(0, x - k) and max(0, k - x) at each knot."""
    new = {}
    for c, ks in knots.items():
        for i, k in enumerate(ks, 1):
            x, at = F.col(c).cast("double"), F.lit(float(k))
            new[f"{c}_up{i}"] = F.greatest(x - at, F.lit(0.0))
            new[f"{c}_dn{i}"] = F.greatest(at - x, F.lit(0.0))
    return df.withColumns(new)
