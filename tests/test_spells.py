import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import spells

from conftest import as_dict, as_set


def test_enrich_refuses_duplicate_keys(rows):
    df = rows([(1,), (2,)], "k int")
    ok = spells.enrich(df, rows([(1, "a")], "k int, s string"), "k", ["s"], {"s": "name"})
    assert as_set(ok, "k", "name") == {(1, "a"), (2, None)}
    with pytest.raises(ValueError):
        spells.enrich(df, rows([(1, "a"), (1, "b")], "k int, s string"), "k", ["s"])


def test_expand_spells_clamp_second_interval_and_direction(rows):
    df = rows([(1, 3, 5, -8, -8), (2, 1, 2, 4, 6), (3, 5, 3, -8, -8)], "u int, s int, e int, s2 int, e2 int")
    got = spells.expand_spells(df, "s", "e", "t", clamp=(2, 5), extra_intervals=[("s2", "e2")], absent=-8)
    assert as_set(got, "u", "t") == {(1, 3), (1, 4), (1, 5), (2, 2), (2, 4), (2, 5)}
    back = spells.expand_spells(df.select("u", "s", "e"), "s", "e", "t", descending="keep")
    assert (3, 4) in as_set(back, "u", "t")


def test_expand_spells_overlapping_intervals_give_a_period_once(rows):
    df = rows([(1, 1, 3, 2, 4)], "u int, s int, e int, s2 int, e2 int")
    assert spells.expand_spells(df, "s", "e", "t", extra_intervals=[("s2", "e2")], absent=-8).count() == 4


def test_spell_flag(rows):
    panel = rows([(1, 1), (1, 2), (2, 1)], "u int, t int")
    got = spells.spell_flag(panel, rows([(1, 2), (1, 2)], "u int, t int"), ["u", "t"], "f")
    assert as_set(got, "u", "t", "f") == {(1, 1, 0), (1, 2, 1), (2, 1, 0)}


@pytest.mark.parametrize("single, want", [("previous", {1949: 1}), ("same", {1950: 1}), ("drop", {})])
def test_spell_count_of_one_period(rows, single, want):
    panel = rows([(1, y) for y in range(1948, 1953)], "u int, y int")
    got = spells.spell_count(panel, rows([(1, 1950, 1950)], "u int, s int, e int"), "u", "y", "s", "e", "n", single_period=single)
    assert {y: n for y, n in as_dict(got, "y", "n").items() if n} == want


def test_spell_count_excludes_the_last_period(rows):
    panel = rows([(1, y) for y in range(1948, 1954)], "u int, y int")
    s = rows([(1, 1950, 1952), (1, 1951, 1953)], "u int, s int, e int")
    got = as_dict(spells.spell_count(panel, s, "u", "y", "s", "e", "n"), "y", "n")
    assert got == {1948: 0, 1949: 0, 1950: 1, 1951: 2, 1952: 1, 1953: 0}
    whole = as_dict(spells.spell_count(panel, s, "u", "y", "s", "e", "n", end_rule="inclusive"), "y", "n")
    assert whole == {1948: 0, 1949: 0, 1950: 1, 1951: 2, 1952: 2, 1953: 1}


def test_state_flags_three_valued(rows):
    df = rows([(1, 1, 1), (1, 2, None), (1, 3, -88), (1, 4, -88), (2, 1, 5), (2, 2, 8), (2, 3, 7)], "u int, t int, p int")
    got = spells.state_flags(df, "u", "t", "p", -66, [-77, -88], 3)
    assert as_set(got, "u", "t", "in_state", "changed") == {
        (1, 1, 0, 0), (1, 2, None, 0), (1, 3, 0, 1), (1, 4, 0, 1), (2, 1, 0, 0), (2, 2, 0, 1), (2, 3, 0, 0),
    }


def test_resolve_primary(rows):
    df = rows(
        [("one", -8, 1), ("two", 10, 1), ("two", -8, 2), ("many", 5, 1), ("many", 6, 2), ("many", 6, 3), ("lost", 5, 1), ("lost", 6, 2)],
        "g string, c int, o int",
    )
    got = spells.resolve_primary(df, "g", "c", -8, rows([("many", 6), ("two", -8)], "g string, c int"), ["o"])
    assert as_set(got, "g", "c", "o") == {("one", -8, 1), ("two", 10, 1), ("many", 6, 2)}


def test_ordered_max(rows):
    levels = rows([(0, "none", 1), (3, "water024", 4), (1, "direct", 6)], "code int, label string, rank int")
    df = rows([(1, 3), (1, 1), (2, 3), (3, 99), (3, None)], "k int, code int")
    got = spells.ordered_max(df, "k", "code", levels, "top", rows([(1,), (2,), (3,), (4,)], "k int"))
    assert as_dict(got, "k", "top") == {1: "direct", 2: "water024", 3: "none", 4: "none"}


def sequential(ts, kills):
    """The definition, one row after the other."""
    out = []
    for i, (t, k) in enumerate(zip(ts, kills)):
        if i == 0:
            out.append(0 if k else 1)
        elif t != ts[i - 1] + 1 or k:
            out.append(0)
        else:
            out.append(out[-1] + 1)
    return out


@pytest.mark.parametrize(
    "ts, kills, want",
    [([1, 2, 3, 4], [0, 0, 1, 0], [1, 2, 0, 1]), ([1, 2, 3], [1, 0, 0], [0, 1, 2]), ([1, 2, 5, 6], [0, 0, 0, 0], [1, 2, 0, 1])],
)
def test_time_since_literal(rows, ts, kills, want):
    df = rows([(1, t, k) for t, k in zip(ts, kills)], "u int, t int, k int")
    got = as_dict(spells.time_since(df, "u", "t", "k"), "t", "time_since")
    assert [got[t] for t in ts] == want == sequential(ts, kills)


def test_time_since_random(rows):
    rng = random.Random(5)
    data, want = [], {}
    for u in range(60):
        ts = sorted(rng.sample(range(60), rng.randint(1, 45)))
        kills = [int(rng.random() < 0.2) for _ in ts]
        data += [(u, t, k) for t, k in zip(ts, kills)]
        want.update({(u, t): x for t, x in zip(ts, sequential(ts, kills))})
    rng.shuffle(data)
    got = spells.time_since(rows(data, "u int, t int, k int"), ["u"], "t", "k")
    assert {(r["u"], r["t"]): r["time_since"] for r in got.collect()} == want


def test_lag_features_stay_inside_the_unit(rows):
    df = rows([(1, 2, 5), (1, 1, 4), (2, 1, 9)], "u int, t int, x int")
    got = spells.lag_features(df, "u", "t", ["x"])
    assert as_set(got, "u", "t", "x_lag") == {(1, 1, None), (1, 2, 4), (2, 1, None)}


def test_unit_windows_share_one_exchange(rows):
    df = rows([(1, 1, 0, 2)], "u int, t int, k int, x int")
    out = spells.lag_features(spells.time_since(df, "u", "t", "k"), "u", "t", ["x", "k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.filter(F.lit(True)).count() == 1


def test_open_periods_equal_flags_of_expanded_spells(spark):
    given = [(1, 3, 5), (1, 3, 3), (1, 9, 9), (2, 7, 4), (2, None, 8), (None, 1, 9), (3, 0, 99), (3, 0, 99), (1, 20, None), (4, 1, 2)]
    rows = spark.createDataFrame(given, "u int, a int, b int")
    units = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (5,), (None,)], "unit int")
    panel = units.withColumn("t", F.explode(F.expr("concat(sequence(0, 12), array(NULL))")))
    want = spells.spell_flag(panel, spells.expand_spells(rows.select(F.col("u").alias("unit"), "a", "b"), "a", "b", "t"), ["unit", "t"], "open")
    got = spells.spell_open(panel, rows.withColumnRenamed("u", "unit"), "unit", "t", "a", "b", "open")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_open_periods_are_found_without_expansion(spark):
    """A spell of a billion periods, and no join of the panel with periods."""
    rows = spark.createDataFrame([(1, 0, 10**9)], "unit int, a int, b int")
    got = spells.spell_open(spark.createDataFrame([(1, 5), (1, -1), (2, 5)], "unit int, t int"), rows, "unit", "t", "a", "b", "open")
    assert sorted(tuple(r) for r in got.collect()) == [(1, -1, 0), (1, 5, 1), (2, 5, 0)]
