import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairlens.llm.rules import COUNTS, Condition, DecisionList, features, judge_quality, learn, learn_rules, statistics, text_counts

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] >= 2 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return [
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines),
        len(re.findall("[A-Z]", text)), len(re.findall(r"[!-/:-@\[-`{-~]", text)), sum(bool(re.fullmatch(r"[!-/:-@\[-`{-~]+", x)) for x in w),
    ]


TEXT = st.lists(st.sampled_from(["a", "b", "ab", "É", "東", "##", "|", " ", " ", "\n", "\t", "\r", "x$", "A b\n", "a b a ", "\x0b"]), max_size=60).map("".join)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_counts_against_brute_force(texts):
    assert text_counts(pa.array(texts, pa.string())).tolist() == [brute(t) for t in texts]


def test_a_list_is_grown_and_pruned_to_what_separates():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4) | (x[:, 2] > 0.95)
    grow = np.arange(3000) % 3 > 0
    found = learn(x, bad, grow, ["a", "b", "c"])
    assert (found.rejected(x, ["a", "b", "c"]) == bad).mean() > 0.99
    assert 2 <= len(found.rules) <= 4 and max(map(len, found.rules)) <= 3
    # Labels without a pattern, or of one kind only, give no rule.
    assert learn(x, rng.random(3000) < 0.1, grow, ["a", "b", "c"]).rules == ()
    assert learn(x, np.zeros(3000, bool), grow, ["a", "b", "c"]).rules == ()
    assert learn(x[:0], bad[:0], grow[:0], ["a", "b", "c"]).rules == ()


def test_pruning_drops_conditions_that_only_fit_the_grown_rows():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.repeat([0.0, 1.0], 300), rng.random(600)])
    bad = (x[:, 0] == 1) & (rng.random(600) < 0.97)
    found = learn(x, bad, np.arange(600) % 3 > 0, ["a", "noise"])
    assert [str(c) for c in found.rules[0]] == ["a > 0.5"]


def test_conditions_are_ordered_spark_expressions(spark):
    rules = DecisionList(((Condition("n_words", False, 2.5),), (Condition("symbols_per_char", True, 0.2), Condition("n_words", True, 3.0))))
    rows = statistics(spark.createDataFrame([(1, "a b"), (2, "## ## ## ##"), (3, "a b c d"), (4, None)], "doc_id int, text string"), ["doc_id"])
    got = {r["doc_id"]: r["rule"] for r in rows.withColumn("rule", rules.column()).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 1}
    assert str(rules).splitlines() == ["1. reject if n_words <= 2.5", "2. reject if symbols_per_char > 0.2 and n_words > 3", "else keep"]
    assert "PythonUDF" not in rows.withColumn("rule", rules.column())._jdf.queryExecution().toString()


def test_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 15)] + [(None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    judged, _ = judge_quality(odd, labels)
    got = sorted((str(r["doc_id"]), *(r[c] for c in COUNTS), r["base_failed"]) for r in judged.collect())
    want = [(str(r[0]), *brute(r[1])) for r in odd_rows]
    assert got == sorted((*w, w[1] < 50 or 100 * w[5] > 50 * w[1]) for w in want)
    for frame, known in ((none, labels), (odd, labels.where("false"))):
        judged, rules = judge_quality(frame, known)
        assert judged.count() == frame.count() and rules.rules == ()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_labels(spark):
    """Rules learned on two thirds of the labelled documents judge the others."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stats = statistics(docs, ["doc_id"])
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rules = learn_rules(stats, labels.where(~part))
    judged = stats.join(labels.where(part), "doc_id").select("quality", (rules.column() == 0).cast("int").alias("kept"))
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    good, bad = counts.get((1, 1), 0) + counts.get((1, 0), 0), counts.get((0, 0), 0) + counts.get((0, 1), 0)
    assert counts.get((1, 1), 0) >= 0.98 * good and counts.get((0, 0), 0) >= 0.85 * bad
    assert set(c.feature for r in rules.rules for c in r) <= set(features())
