"""Plan shapes that must hold at any size, and keys that hold a third of the rows."""

import os
import re

import pytest
from pyspark.sql import Window as W, functions as F

import __spark_entry__ as entry_points
from pairlens.functions import hash_rank, ranked_counts
from pairlens.operators import clean, codes, pairs, sampling, scoring

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The operators of the training-data subpackage have tests of their own.
# Fits of whole grids run when they are planned; what they plan is one scoring pass per setting.
GRIDS = r"k(3|4|7|8|9|10|11|12|16)_|k6_(splines|adaptive)|k5_kernel_bayes"
PLANNED = sorted(n for n in entry_points.queries() if not re.match(rf"op\d+_|pipeline|{GRIDS}", n))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def one_task_windows(df) -> list[str]:
    """Window nodes of the optimised plan that have no partition columns."""
    nodes, found = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Window" and node.partitionSpec().isEmpty():
            found.append(node.simpleString(200))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_the_walk_finds_a_one_task_window(spark):
    rank = F.row_number().over(W.orderBy("id"))
    assert one_task_windows(spark.range(9).withColumn("r", rank)) and not one_task_windows(spark.range(9))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_and_no_one_task_window(spark, name):
    df = entry_points.queries()[name](spark, SF)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not one_task_windows(df)


@pytest.fixture
def skewed(spark):
    """3,000 rows; key 0 holds a third of them."""
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    return spark.range(3000).select("id", hot.alias("k"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 50 == 0).cast("int").alias("y"))


def test_group_filter_with_a_hot_key(skewed):
    got = codes.group_filter(skewed, "k", any_=F.col("v") == 6)
    assert got.where("k = 0").count() == 1000
    assert "Window" not in plan_of(got)


def test_keep_first_with_a_hot_key(skewed):
    got = clean.keep_first(skewed, "k", ["id"])
    assert got.count() == 2001 and got.where("k = 0").first()["id"] == 0
    assert "partial_min" in plan_of(got)


def test_ranks_of_a_hot_class_are_cut_into_buckets(skewed):
    flat = skewed.withColumn("c", F.col("id") % 1)
    ranked = hash_rank(flat, "id", ["c"], 1)
    assert {r[0] for r in ranked.select("rank").collect()} == set(range(1, 3001))
    assert re.search(r"Window \[row_number.*\[c#\d+L?, bucket#\d+\], \[hash", plan_of(ranked))
    counts = ranked_counts(skewed, "id", bucket_values=200)
    assert [r["cum"] for r in counts.orderBy("id").collect()] == list(range(1, 3001))


def test_split_and_auc_with_a_dominant_class(skewed):
    parts = sampling.train_eval_test(skewed, "y", "id")
    assert parts.where("part = 'train' AND y = 0").count() == 1764 and parts.count() == 3000
    a = scoring.auc(skewed.withColumn("p", F.col("id") / 3000.0), "y", "p").first()[0]
    ids = [i for i in range(3000) if i % 50 == 0]
    want = sum(i - ids.index(i) for i in ids) / (len(ids) * (3000 - len(ids)))
    assert abs(a - want) < 1e-12


def test_hot_event_and_hot_period(rows):
    people = [("big", i % 2, i, 1, 1) for i in range(120)] + [(f"e{i}", i % 2, i, 1, 1) for i in range(100)]
    got = pairs.event_pairs(rows(people, "e string, s int, u int, a int, b int"), "e", "s", "u", "a", "b", side_rows=7)
    assert got.count() == 3600 and got.distinct().count() == 3600
    panel = rows([(u, 1) for u in range(150)] + [(u, t) for t in range(2, 30) for u in range(3)], "u int, t int")
    made = pairs.make_pairs(panel, "u", "t")
    assert made.count() == 150 * 149 // 2 + 28 * 3 == made.distinct().count()
