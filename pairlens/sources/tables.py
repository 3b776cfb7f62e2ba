"""Reading source tables and storing imputed replicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_source(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    fmt: str = "parquet",
    header: bool = True,
    na_values: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read a CSV, ORC, JSON or parquet table and keep the needed columns.

    ``header=False`` names the columns of a CSV file by position from ``schema``.
    ``na_values`` become NULL: in a CSV every sentinel text, compared before the
    cast to the target type; in the typed formats in the string columns.
    """
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV source needs a fixed schema")
        target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        text = StructType.fromDDL(", ".join(f"`{f.name}` string" for f in target.fields))
        raw = spark.read.schema(text).csv(path, header=header, enforceSchema=not header)
        keep = [f for f in target.fields if columns is None or f.name in columns]
        out = []
        for f in keep:
            cell = F.col(f.name)
            if na_values:
                cell = F.when(~F.trim(cell).isin(list(na_values)), cell)
            out.append(cell.cast(f.dataType).alias(f.name))
        df = raw.select(*out)
    else:
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.load(path)
        strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        if na_values:
            df = df.withColumns({c: F.when(~F.col(c).isin(list(na_values)), F.col(c)) for c in strings})
    return df.select(*columns) if columns is not None else df


def write_replicates(
    df: DataFrame, path: str, by: Sequence[str] = ("imp_i", "imp_j"), mode: str = "errorifexists"
) -> None:
    """Store all replicates as one table, one folder per replicate.

    The rows are not shuffled by replicate first: each task writes the replicates
    it holds, so few replicates do not mean few writers.
    """
    df.write.mode(mode).partitionBy(*by).parquet(path)


def read_replicate(spark: SparkSession, path: str, **replicate: int) -> DataFrame:
    """Read one replicate (``imp_i=1, imp_j=3``); the filter prunes the other folders."""
    df = spark.read.parquet(path)
    for name, value in replicate.items():
        df = df.where(F.col(name) == value)
    return df


def replicate_ids(spark: SparkSession, path: str, by: Sequence[str] = ("imp_i", "imp_j")) -> list[tuple]:
    """The replicate keys of a stored table, in order (read from the folder names)."""
    rows = spark.read.parquet(path).select(*by).distinct().orderBy(*by).collect()
    return [tuple(r) for r in rows]
