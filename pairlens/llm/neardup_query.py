"""op1: the near-duplicate class of every document."""

from pyspark.sql import DataFrame, SparkSession

from .neardup import near_duplicates
from .registry import query, table


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
