"""op5: the quality of every document."""

from pyspark.sql import DataFrame, SparkSession

from .quality import score_quality
from .registry import query, table


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
