"""op9: the pseudo-log-likelihood of every document under a model of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .lm import score_documents
from .registry import query, table


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), ["doc_id"])
