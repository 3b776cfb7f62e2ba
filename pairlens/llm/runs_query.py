"""op11: periodic runs of words, in texts of which a tenth is made periodic by rule."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .recompress import BLANKS
from .registry import query, table
from .runs import find_runs, longest

# The twin computes crc32 bit by bit, looks for four equal words on the multiples of each period, and extends by counting.
SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
crc AS (
  SELECT r, doc_id, w, len(w) AS n, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
    lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))) AS h
  FROM doc),
cut AS (SELECT *, (h // 10) AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM crc),
per AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM cut),
txt AS (
  SELECT r, doc_id, n, CASE WHEN p IS NULL THEN w ELSE [w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1] FOR i IN range(0, n)] END AS w FROM per),
grid AS (SELECT r, w, q, unnest(range(0, n, q)) AS i FROM (SELECT r, w, n, unnest(range(1, n // 4 + 1)) AS q FROM txt)),
cand AS (SELECT DISTINCT r, q FROM grid WHERE w[i + 1] = w[i + q + 1] AND w[i + 1] = w[i + 2 * q + 1] AND w[i + 1] = w[i + 3 * q + 1]),
same AS (
  SELECT r, q, i FROM (SELECT r, q, w, unnest(range(0, n - q)) AS i FROM cand JOIN txt USING (r)) WHERE w[i + 1] = w[i + q + 1]),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
found AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM isle GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, l, min(q) AS q FROM found GROUP BY r, s, l),
per_doc AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         min({'l': -l, 's': s, 'q': q}) AS best FROM run GROUP BY r),
gone AS (SELECT r, list(i) AS ps FROM (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * -best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [x FOR x, i IN w IF NOT list_contains(ps, i - 1)] END, ' ')) AS collapsed_sha256
FROM txt LEFT JOIN per_doc USING (r) LEFT JOIN gone USING (r)
"""


def periodic_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document, by a hash of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # An empty piece can only stand at the begin or the end of a split text.
    w = F.array_remove(F.split("text", BLANKS), "")
    planted = F.when((h % 10 == 0) & F.col("text").isNotNull(), w)
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), planted.alias("w"), F.size(planted).cast("long").alias("n"))
    a = F.expr("CASE WHEN n > 0 THEN g % n END")
    rows = rows.withColumn("a", a.cast("int")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, CAST(n - a AS INT))")
    periodic = F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(periodic_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = found.withColumn("best", longest("runs"))
    one = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(one(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
