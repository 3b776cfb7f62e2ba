"""op6: personal data in every document."""

from pyspark.sql import DataFrame, SparkSession

from .pii import find_personal_data
from .registry import query, table


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
