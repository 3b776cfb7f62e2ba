"""A training corpus from raw documents: good ones, one of each kind, without test items or personal data, mixed.

Each stage takes (session, documents, folder of the tables) and returns documents; its result
is written and read again before the next stage.  Columns other than those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.llm.decontam import decontaminate
from pairlens.llm.mixing import take_mix
from pairlens.llm.neardup import keep_one
from pairlens.llm.pii import redact
from pairlens.llm.quality import keep_good
from pairlens.llm.registry import prepare, table
from pairlens.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No stage but the last could be stated in SQL: the first is a fitted network.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` again, as the text may have changed."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.5)."""
    prepare(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"), COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of smallest id."""
    prepare(spark)
    return keep_one(docs, COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    prepare(spark)
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark"), columns=COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    prepare(spark)
    return _counted(redact(docs, COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``, how often it takes them."""
    prepare(spark)
    return take_mix(docs, COLUMNS)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
