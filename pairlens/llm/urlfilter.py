"""URL filters: pattern rules found through their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A rule without a literal token is a candidate for every URL, under this token.
EVERY = ""


@dataclass(frozen=True)
class Rule:
    """A pattern over ``host + path``; ``tokens`` are literals that every match holds as whole tokens."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...] = ()
    # Of the rules that match a URL, those of the highest rank count, and of these the longest name.
    rank: int = 0


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER))) if t))


def site_rule(action: str, rule: str, rank: int = 1) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    path = slash + path
    host = host.translate(str.maketrans(UPPER, LOWER))
    # The last segment of a path prefix may go on in the URL, so it is no whole token.
    whole = path[: path.rindex("/") + 1] if slash else ""
    pattern = rf"^(?:[^/]*\.)?\Q{host}\E" + (rf"\Q{path}\E" if path else "")
    return Rule(host + path, action, pattern, tokens_of(f"{host} {whole}"), rank)


def host_word_rule(action: str, words: str, rank: int = 0) -> Rule:
    """Hosts with a label that holds the hyphenated ``words``, such as ``cheap-pills``."""
    return Rule(words, action, rf"^[^/]*(?<![a-z0-9])\Q{words}\E(?![a-z0-9])", tokens_of(words), rank)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    found = F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(found, F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+"))


def _rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.name, r.action, r.pattern, r.rank, list(r.tokens) or [EVERY]) for i, r in enumerate(rules)]
    schema = "rule_no int, rule string, action string, pattern string, rank int, tokens array<string>"
    return spark.createDataFrame(rows, schema)


def judge_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Distinct URLs with ``url, host, path, rule, rank, verdict``.

    Each rule is filed under the one of its literal tokens that the URLs hold least often.  A
    URL's tokens fetch the rules filed under them, and only those run their regular
    expression.  Of the matches the highest rank wins, then the longest name, then the first
    name; a URL without a match gets ``default`` and a null rule.

    URLs are judged once each, however often they occur.  Null URLs are left out: they have
    no host, path or tokens.  A URL without ``://`` has an empty host and path.  The rules
    are a list of the driver's; whether their table is broadcast is left to Spark's size limit.
    """
    rules = list(rules)
    spark = pages.sparkSession
    urls = pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = materialize(urls, "urls")
    target = F.concat("host", "path")
    # The split of a non-empty text never loses the empty token: it stands for the rules without a literal.
    tokens = F.explode(F.array_union(url_tokens(target), F.array(F.lit(EVERY))))
    seen = urls.select("url", target.alias("target"), tokens.alias("token"))

    filed = _rule_table(spark, rules).withColumn("token", F.explode("tokens")).drop("tokens")
    wanted = filed.select("token").distinct()
    counts = seen.select("token").join(wanted, "token", "left_semi").groupBy("token").count()
    rarest = W.partitionBy("rule_no").orderBy("count", "token")
    index = filed.join(counts, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    index = index.withColumn("nth", F.row_number().over(rarest)).where("nth = 1").drop("nth", "count")
    index = materialize(index.coalesce(1), "url-rules")

    matched = seen.join(index, "token").where(F.regexp(F.col("target"), F.col("pattern")))
    best = F.min(F.struct((-F.col("rank")).alias("r"), (-F.length("rule")).alias("l"), "rule", "action")).alias("best")
    matched = matched.groupBy("url").agg(best)
    out = urls.join(matched, "url", "left")
    verdict = F.coalesce(F.col("best.action"), F.lit(default))
    return out.select("url", "host", "path", F.col("best.rule").alias("rule"), (-F.col("best.r")).alias("rank"), verdict.alias("verdict"))


def filter_pages(
    pages: DataFrame, rules: Iterable[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """Every page with ``page_id, host, path, rule, rank, verdict``; one row per row of ``pages``.

    A null URL has an empty host and path, no rule and the default verdict.  Columns other than
    the id and the URL are ignored.
    """
    judged = judge_urls(pages, rules, default, url)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).join(judged, "url", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    verdict = F.coalesce("verdict", F.lit(default)).alias("verdict")
    return rows.select("page_id", blank("host"), blank("path"), "rule", "rank", verdict)
