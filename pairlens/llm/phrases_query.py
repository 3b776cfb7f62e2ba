"""op12: word collocations of every language."""

from pyspark.sql import DataFrame, SparkSession

from .phrases import collocations
from .registry import query, table

SQL = r"""
WITH doc AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM doc)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY 1),
gram AS (
  SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, g, count(*)::BIGINT AS c FROM gram GROUP BY 1, 2 HAVING count(*) >= 10),
cand AS (SELECT lang, g, c AS a FROM f WHERE len(g) > 1),
cut AS (
  SELECT cand.lang, cand.g, a, k, x.c AS l, y.c AS r, ((1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM cand) cand
  JOIN f x ON x.lang = cand.lang AND x.g = cand.g[1 : k] JOIN f y ON y.lang = cand.lang AND y.g = cand.g[k + 1 :]),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_f AS (SELECT lang, sub, max(a) AS longer FROM (
  SELECT lang, g[1 : 2] AS sub, a FROM cand WHERE len(g) = 3 UNION ALL SELECT lang, g[2 : 3], a FROM cand WHERE len(g) = 3) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN inner_f ON inner_f.lang = low.lang AND sub = g WHERE longer IS NULL OR 100 * longer < 50 * a),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named JOIN total USING (lang) QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)
