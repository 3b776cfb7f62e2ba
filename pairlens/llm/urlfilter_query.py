"""op8: a verdict for every page."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query, table
from .urlfilter import Rule, filter_pages, host_word_rule, site_rule

SITES = (
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
)
# What the method judges where no site rule fits: kinds of hosts that crawls commonly leave out.
UNWANTED = ("cheap-pills", "spam-farm", "casino-win", "free-bets", "ads-track", "adult-x")
PATTERNS = tuple(host_word_rule("block", w) for w in UNWANTED) + (
    Rule("numeric host", "block", r"^[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?(?:/|$)"),
)

SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule, rhost, rpath, action) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
best AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, b.rule,
       coalesce(b.action, CASE
         WHEN regexp_matches(p.host, '(^|[^a-z0-9])(cheap-pills|spam-farm|casino-win|free-bets|ads-track|adult-x)($|[^a-z0-9])') THEN 'block'
         WHEN regexp_matches(p.host || p.path, '^[0-9]+(\.[0-9]+){3}(:[0-9]+)?(/|$)') THEN 'block'
         ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


@query("op8_url_filter", SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_pages(table(spark, sf_dir, "pages"), SITES + PATTERNS)
    rule = F.when(F.col("rank") == 1, F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")
