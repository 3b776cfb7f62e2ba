from pyspark.sql import functions as F

from pairlens.llm.urlfilter import EVERY, Rule, filter_pages, host_of, host_word_rule, path_of, site_rule, tokens_of
from pairlens.llm.urlfilter_query import PATTERNS, SITES

URLS = {
    1: ("http://www.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    2: ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    3: ("https://m.example.com/EN/", "m.example.com", "/EN/", "com/", "allow"),
    4: ("https://com", "com", "", None, "allow"),
    5: ("https://telecom/", "telecom", "/", None, "allow"),
    6: ("https://a.net/es/#t", "a.net", "/es/", "net/es/", "block"),
    7: ("https://a.net/es", "a.net", "/es", None, "allow"),
    8: (None, "", "", None, "allow"),
    9: ("no scheme.com/", "", "", None, "allow"),
    10: ("://", "", "", None, "allow"),
    11: ("http://m.spam-farm.example.org/x", "m.spam-farm.example.org", "/x", None, "block"),
    12: ("http://spam-farming.example.org/x", "spam-farming.example.org", "/x", None, "allow"),
    13: ("http://spam-farm.example.com/x", "spam-farm.example.com", "/x", "com/", "allow"),
    14: ("http://10.0.0.1:80/x", "10.0.0.1:80", "/x", None, "block"),
    15: ("x://y://z/q", "y:", "//z/q", None, "allow"),
    16: ("http://É.net/fr/?", "É.net", "/fr/", "net/fr/", "block"),
    17: ("http://a.com?b/", "a.com", "", None, "allow"),
    18: ("http://a\n.net/fr/\nb", "a\n.net", "/fr/\nb", "net/fr/", "block"),
}


def test_verdicts(spark):
    rows = [(i, u[0], "h", "p", "t", "r") for i, u in URLS.items()]
    df = spark.createDataFrame(rows + rows[:2] + [(None, rows[0][1], "h", "p", "t", "r")], "page_id long, url string, host string, path string, token string, rule string").repartition(3)
    got = filter_pages(df, SITES + PATTERNS).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        want = URLS[r["page_id"] or 1]
        assert (r["host"], r["path"], r["verdict"]) == (want[1], want[2], want[4]), r
        assert (r["rule"] if r["rank"] == 1 else None) == want[3]
    assert filter_pages(df.limit(0), SITES).count() == 0


def test_rules_without_literals_meet_every_url(spark):
    rule = Rule("digits", "block", r"[0-9]{4}")
    df = spark.createDataFrame([(1, "http://a/12345"), (2, "http://a/1"), (3, "http://b9999")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in filter_pages(df, [rule, host_word_rule("allow", "zzz")]).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"} and EVERY == ""


def test_tokens_of_path_prefixes_are_whole_segments():
    assert site_rule("block", "A.com/en/x").tokens == ("a", "com", "en")
    assert site_rule("block", "a.com").tokens == ("a", "com")
    assert tokens_of("Cheap-Pills É9") == ("cheap", "pills", "9")


def test_the_longest_rule_wins_and_rank_goes_first(spark):
    rules = [site_rule("block", "a.com/"), site_rule("allow", "b.a.com/x/"), host_word_rule("block", "very-long-word-rule")]
    df = spark.createDataFrame([(1, "http://c.b.a.com/x/y"), (2, "http://very-long-word-rule.b.a.com/x/"), (3, "http://very-long-word-rule/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_pages(df, rules).collect()}
    assert got == {1: ("b.a.com/x/", "allow"), 2: ("b.a.com/x/", "allow"), 3: ("very-long-word-rule", "block")}


def test_host_and_path_expressions(spark):
    df = spark.createDataFrame([("HTTP://Ab.C?x",), ("a//b",)], "url string").select(host_of(F.col("url")), path_of(F.col("url")))
    assert [tuple(r) for r in df.collect()] == [("ab.c", ""), ("", "")]
