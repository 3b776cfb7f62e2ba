"""op10: words of passages of 50 words that started in an earlier document."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .recompress import dedup_substrings
from .registry import query, table

SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)),
start AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN start USING (g) WHERE first < doc_id),
lost AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [x for x, i in w if NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM doc LEFT JOIN lost USING (r)
"""


@query("op10_substring_dedup", SQL)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"), length=50, value=lambda words: F.sha2(words, 256))
    return kept.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
