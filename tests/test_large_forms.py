"""Forms for large inputs against their plain definitions."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pairlens.operators import codes, pairs, spells

from conftest import as_dict, as_set


def test_every_rank_is_one_pair(spark):
    n = 300
    i, j = pairs.unranked_pair(F.col("id"))
    got = [tuple(r) for r in spark.range(n * (n - 1) // 2).select(i.alias("i"), j.alias("j")).orderBy("id").collect()]
    assert got == [(i, j) for j in range(n) for i in range(j)]
    # Around large triangular numbers the root is rounded.
    for big in (10**7 + 1, 9 * 10**7, 94_906_266):
        t = big * (big - 1) // 2
        for r, want in ((t - 1, (big - 2, big - 1)), (t, (0, big)), (t + big - 1, (big - 1, big))):
            i, j = pairs.unranked_pair(F.lit(r))
            assert tuple(spark.range(1).select(i, j).first()) == want


@pytest.fixture
def market(spark):
    panel = spark.createDataFrame([(u, t) for t, n in ((1, 12), (2, 1), (3, 9)) for u in range(n)] + [(3, 1), (None, 1)], "u int, t int")
    cases = spark.createDataFrame([(0, 1, 1), (3, 2, 1), (5, 8, 3), (5, 8, 3), (0, 11, 3), (4, 4, 1)], "a_unit int, b_unit int, t int")
    return panel, cases


def test_controls_are_drawn_evenly_from_pairs_without_a_case(market):
    panel, cases = market
    drawn = pairs.case_control_pairs(panel, "u", "t", cases, ratio=4000, seed=5)
    rows = {(r["a_unit"], r["b_unit"], r["t"]): (r["label"], r["n_draws"]) for r in drawn.collect()}
    universe = {tuple(r) for r in pairs.make_pairs(panel.dropna(), "u", "t").select("a_unit", "b_unit", "t").collect()}
    known = {(0, 1, 1), (2, 3, 1), (5, 8, 3)}
    controls = {k: n for k, (label, n) in rows.items() if label == 0}
    assert set(controls) == universe - known and sum(controls.values()) == 12_000
    mean = 12_000 / len(controls)
    assert sum((n - mean) ** 2 / mean for n in controls.values()) < len(controls) + 5 * (2 * len(controls)) ** 0.5
    positives = {k: n for k, (label, n) in rows.items() if label == 1}
    assert set(positives) <= known and sum(positives.values()) == 3
    again = pairs.case_control_pairs(panel.repartition(7), "u", "t", cases.repartition(3), ratio=4000, seed=5)
    assert {(r["a_unit"], r["b_unit"], r["t"]): (r["label"], r["n_draws"]) for r in again.collect()} == rows


def test_controls_need_cases_and_bounded_periods(spark, market, monkeypatch):
    panel, cases = market
    with pytest.raises(ValueError, match="no cases"):
        pairs.case_control_pairs(panel, "u", "t", cases.where("false"))
    monkeypatch.setattr(pairs, "MAX_PERIODS", 2)
    with pytest.raises(ValueError, match="periods"):
        pairs.case_control_pairs(panel, "u", "t", cases)


SPELLS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 30)), st.one_of(st.none(), st.integers(-5, 30))), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SPELLS, st.sampled_from([1, 4, 1000]))
def test_sweeps_equal_expanded_spells(spark, data, span):
    df = spark.createDataFrame(data, "u string, s int, e int")
    want = Counter((u, t) for u, s, e in data if s is not None and e is not None for t in range(s, e + 1))
    spans = spells.running_spans(df, "u", "s", "e", span).collect()
    got = Counter()
    for r in spans:
        for t in range(r["first"], r["last"] + 1):
            got[r["u"], t] += r["n"]
    mine = {k: n for k, n in want.items() if k[0] is not None}
    assert {k: n for k, n in got.items() if k[0] is not None} == mine and len(spans) == len({(r["u"], r["first"]) for r in spans})
    points = [(u, t, "x") for u in ("a", "b", "c", None) for t in range(-7, 33, 3)] * 2 + [("a", None, "y")]
    counted = spells.count_at(spark.createDataFrame(points, "u string, t int, other string"), df, "u", "t", "s", "e", "n", span).collect()
    assert len(counted) == len(points)
    assert all(r["n"] == (mine.get((r["u"], r["t"]), 0) if r["u"] else 0) for r in counted)


def test_long_spells_take_two_changes(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("u"), F.col("id").alias("s"), (F.col("id") + 15_000).alias("e"))
    assert spells._changes(df, ["u"], "s", "e").count() == 2000
    assert spells.running_spans(df, "u", "s", "e").agg(F.sum((F.col("last") - F.col("first") + 1) * F.col("n"))).first()[0] == 1000 * 15_001


def test_interval_join_equals_the_plain_one(rows):
    mapping = rows([(1, -50, 10, 7), (1, 11, 10**9, 8), (2, 0, 5, None), (2, 6, 6, 9), (3, 4, 2, 5), (4, 3, None, 6)], "raw_code int, valid_from int, valid_to int, canonical_code int")
    data = [(c, t, f"{c}-{t}") for c in (1, 2, 3, 4, 5, None) for t in (-3, 0, 5, 6, 10, 11, 400)]
    df = rows(data, "code int, t int, name string")
    for drop in (True, False):
        plain = codes.conform_codes(df, "code", "t", mapping, drop_invalid=drop)
        for parts in (1, 3, 64):
            got = codes.conform_by_intervals(df, "code", "t", mapping, drop_invalid=drop, parts=parts)
            assert as_set(got, "code", "t", "name") == as_set(plain, "code", "t", "name") and got.count() == plain.count()
    assert codes.conform_by_intervals(df.where("false"), "code", "t", mapping).count() == 0


def test_overlapping_intervals_raise_with_the_rows(rows):
    df = rows([(1, t) for t in range(0, 1000, 7)], "code int, t int")
    clash = rows([(1, 0, 500, 7), (1, 500, 900, 8), (2, 0, 3, 1)], "raw_code int, valid_from int, valid_to int, canonical_code int")
    with pytest.raises(ValueError, match="1: 500 to 900 after 500"):
        codes.conform_by_intervals(df, "code", "t", clash)
    # Beyond the time of the data nothing is multiplied.
    late = rows([(1, 0, 500, 7), (1, 5000, 9000, 8), (1, 6000, 7000, 8)], "raw_code int, valid_from int, valid_to int, canonical_code int")
    assert as_dict(codes.conform_by_intervals(df, "code", "t", late), "t", "code") == {t: 7 for t in range(0, 501, 7)}


def test_a_hot_code_is_spread_and_not_broadcast(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("code"), (F.col("id") % 640).alias("t"))
    mapping = spark.range(3000).select(F.col("id").alias("raw_code"), F.lit(0).alias("valid_from"), F.lit(639).alias("valid_to"), (F.col("id") + 1).alias("canonical_code"))
    out = codes.conform_by_intervals(df, "code", "t", mapping)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "__part" in plan
    assert out.where("code = 1").count() == 1000
