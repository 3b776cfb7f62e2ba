"""op4: all documents mixed to the weights 5, 2, 1."""

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix_sources
from .registry import query, table

SQL = r"""
WITH piece AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM piece GROUP BY source),
ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS wanted
  FROM sized),
levels AS (
  SELECT *, row_number() OVER o AS place,
         (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
edge AS (SELECT min(place) AS place FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN e.place IS NULL OR l.place < e.place THEN l.cap ELSE least(l.cap, f.level * l.weight) END AS target
  FROM levels l CROSS JOIN edge e LEFT JOIN levels f ON f.place = e.place),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, t.epochs,
         t.target - t.epochs * t.source_size AS budget,
         sum(p.size) OVER (PARTITION BY p.source ORDER BY p.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high,
         sum(p.size) OVER (PARTITION BY p.source, p.h) AS words
  FROM piece p JOIN plan t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN high + (high - words) <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


@query("op4_mix_sources", SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
