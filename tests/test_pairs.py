import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import pairs as P

from conftest import as_set


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_make_pairs_numeric_and_text(rows, blocks):
    panel = rows([(u, 1) for u in (2, 10, 20, 100)] + [(2, 2), (10, 2), (2, 3)], "u int, y int")
    got = as_set(P.make_pairs(panel, "u", "y", blocks=blocks), "a_unit", "b_unit", "y")
    assert got == {(a, b, 1) for a, b in itertools.combinations((2, 10, 20, 100), 2)} | {(2, 10, 2)}
    text = as_set(P.make_pairs(panel, "u", "y", order="text", blocks=blocks), "a_unit", "b_unit", "y")
    assert ("10", "2", 2) in text and ("100", "2", 1) in text and len(text) == 7


def test_attach_sides_per_replicate(rows):
    panel = rows([(1, 1, u, u * 10 + i) for i in (0, 1) for u in (1, 2)] and [(i, 1, u, u * 10 + i) for i in (0, 1) for u in (1, 2)], "imp int, y int, u int, v int")
    pairs = rows([(1, 2, 1)], "a_unit int, b_unit int, y int")
    got = P.attach_sides(pairs, panel.drop("imp").where("v % 2 = 0"), ["v"], "u", "y")
    assert as_set(got, "a_unit", "b_unit", "A_v", "B_v") == {(1, 2, 10, 20)}
    # Replicates must not mix.
    reps = P.attach_sides(pairs, panel, ["v"], "u", "y", by=["imp"])
    assert as_set(reps, "imp", "A_v", "B_v") == {(0, 10, 20), (1, 11, 21)}


def test_attach_sides_drops_a_pair_without_a_side(rows):
    panel = rows([(1, 1, 5)], "u int, y int, v int")
    assert P.attach_sides(rows([(1, 2, 1)], "a_unit int, b_unit int, y int"), panel, ["v"], "u", "y").count() == 0


@pytest.mark.parametrize("side_rows", [1, 2, 1000])
def test_event_pairs(rows, side_rows):
    data = [
        ("x", 1, 1, 1950, 1951), ("x", 1, 2, 1949, 1950), ("x", 0, 3, 1950, 1955), ("x", 0, 1, 1950, 1950), ("x", 0, 3, 1950, 1950),
        ("no_b", 1, 1, 1960, 1960), ("no_a", 0, 1, 1960, 1960),
    ]
    got = P.event_pairs(rows(data, "e string, s int, u int, a int, b int"), "e", "s", "u", "a", "b", side_rows=side_rows)
    # A unit on both sides is not paired with itself; repeated participants count once.
    assert sorted(tuple(r) for r in got.collect()) == [("x", 1, 3, 1949, 1955), ("x", 2, 1, 1949, 1955), ("x", 2, 3, 1949, 1955)]


def brute_flags(pairs, events, horizon):
    out = {}
    for a, b, t in pairs:
        mine = [e for e in events if {e[1], e[2]} == {a, b}]
        out[(a, b, t)] = (
            int(any(e[1] == a and e[3] == t for e in mine)),
            int(any(e[1] == b and e[3] == t for e in mine)),
            int(any(e[3] <= t <= e[4] for e in mine)),
            int(any(e[3] <= t <= e[4] + horizon for e in mine)),
        )
    return out


def test_event_flags_match_brute_force_and_each_other(rows):
    rng = random.Random(3)
    pairs = [(a, b, t) for t in range(1, 15) for a, b in itertools.combinations(range(5), 2)]
    events = []
    for i in range(25):
        a, b = rng.sample(range(5), 2)
        s = rng.randint(1, 12)
        events.append((i, a, b, s, s + rng.randint(0, 4)))
    p = rows(pairs, "a_unit int, b_unit int, t int")
    e = rows(events, "event int, attacker int, target int, start int, end int")
    steps = P.onset_flags(p, e, "t")
    steps = P.ongoing_flag(steps, e, "t", "on")
    steps = P.ongoing_flag(steps, e, "t", "recent", horizon=3)
    once = P.event_flags(p, e, "t", {"on": 0, "recent": 3}, clamp=(1, 14))
    want = brute_flags(pairs, events, 3)
    for df in (steps, once):
        got = {(r["a_unit"], r["b_unit"], r["t"]): (r["A_attacked"], r["B_attacked"], r["on"], r["recent"]) for r in df.collect()}
        assert got == want


def test_pair_attributes_swap_sides_with_the_key(rows):
    pairs = rows([(1, 2, 1), (1, 3, 1)], "a_unit int, b_unit int, y int")
    table = rows([(2, 1, 1, 20.0, 10.0, 7)], "c1 int, c2 int, y int, flow1 double, flow2 double, n int")
    got = P.pair_attributes(pairs, table, "c1", "c2", "y", {"flow": ("flow1", "flow2")}, {"ud_n": "n"}, "ud_any", fill={"ud_n": 0})
    assert as_set(got, "a_unit", "b_unit", "A_flow", "B_flow", "ud_n", "ud_any") == {(1, 2, 10.0, 20.0, 7, 1), (1, 3, None, None, 0, 0)}
    plain = P.pair_attributes(pairs, table, "c1", "c2", "y", {"flow": ("flow1", "flow2")}, canonicalize=False)
    assert as_set(plain, "b_unit", "A_flow") == {(2, None), (3, None)}


def test_directed_membership(rows):
    pairs = rows([(1, 2, 1), (1, 2, 2)], "a_unit int, b_unit int, y int")
    claims = rows([(2, 1, 1), (2, 1, 1), (1, 2, 2), (2, 1, 2)], "src int, dst int, y int")
    got = P.directed_membership(pairs, claims, "src", "dst", "y", ("A_c", "B_c"))
    assert as_set(got, "y", "A_c", "B_c") == {(1, 0, 1), (2, 1, 1)}


def test_pair_static_lookup_reorders_substitutes(rows):
    pairs = rows([(1, 2, 1), (1, 2, 2), (1, 9, 1), (3, 9, 1), (2, 3, 1), (5, 6, 1)], "a_unit int, b_unit int, y int")
    table = rows([(2, 1, 100.0), (3, 2, 0.0), (1, 2, 100.0)], "a int, b int, km double")
    got = P.pair_static_lookup(
        pairs, table, "a", "b", "km", "ud_distance", rows([(9, 2)], "code int, substitute int"), 8.0,
        rows([(5, 6, 1.0)], "a_unit int, b_unit int, km double"),
    )
    # (3, 9) becomes (3, 2), which is stored as (2, 3).
    assert as_set(got, "a_unit", "b_unit", "y", "ud_distance") == {
        (1, 2, 1, 100.0), (1, 2, 2, 100.0), (1, 9, 1, 100.0), (3, 9, 1, 8.0), (2, 3, 1, 8.0), (5, 6, 1, 1.0),
    }


def test_mirror_pairs(rows):
    df = rows([(1, 2, 1, 5, 7, 9)], "a_unit int, b_unit int, y int, A_x int, B_x int, ud_z int")
    assert as_set(P.mirror_pairs(df), *df.columns) == {(1, 2, 1, 5, 7, 9), (2, 1, 1, 7, 5, 9)}
    with pytest.raises(ValueError):
        P.mirror_pairs(df.withColumn("A_only", F.lit(1)))
