import math
import random

from pyspark.sql import functions as F

from pairlens.functions import (
    asinh_odd,
    exact_quantiles,
    flag,
    hash_cutoff,
    hash_rank,
    in_set,
    md5_key,
    normal_cdf,
    ranked_counts,
    seeded_draw,
)

from conftest import as_dict, as_set


def test_normal_cdf_is_close(rows):
    df = rows([(x / 7.0,) for x in range(-30, 31)], "z double").withColumn("p", normal_cdf(F.col("z")))
    for z, p in df.collect():
        assert abs(p - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-7


def test_asinh_is_odd_for_large_values(rows):
    got = as_dict(rows([(-1e12,), (1e12,), (0.0,)], "x double").withColumn("y", asinh_odd(F.col("x"))), "x", "y")
    assert got[-1e12] == -got[1e12] and math.isclose(got[1e12], math.asinh(1e12)) and got[0.0] == 0


def test_three_valued_flags(rows):
    df = rows([(1,), (None,), (3,)], "x int")
    out = df.select("x", flag(F.col("x") == 1).alias("f"), in_set(F.col("x"), [1, 2]).alias("s"))
    assert as_set(out, "x", "f", "s") == {(1, 1, True), (None, None, False), (3, 0, False)}


def test_seeded_draw_matches_hashlib(rows):
    import hashlib

    df = rows([(i,) for i in range(50)], "i bigint").withColumn("d", seeded_draw(9, F.col("i")))
    for i, d in df.collect():
        assert d == int(hashlib.md5(f"9:{i}".encode()).hexdigest()[:15], 16)


def test_ranked_counts_with_and_without_buckets(rows):
    rng = random.Random(1)
    # One group holds most rows, and one value is very frequent.
    data = [("big" if rng.random() < 0.9 else "small", None if rng.random() < 0.05 else rng.choice([5.0, rng.random() * 100])) for _ in range(3000)]
    df = rows(data, "g string, v double").repartition(5)
    want = {}
    for g in ("big", "small"):
        vals = sorted(v for h, v in data if h == g and v is not None)
        for v in set(vals):
            want[(g, v)] = (vals.count(v), sum(1 for x in vals if x <= v))
    for size in (10**6, 100):
        got = {(r["g"], r["v"]): (r["cnt"], r["cum"]) for r in ranked_counts(df, "v", ["g"], bucket_values=size).collect()}
        assert got == want
    total = ranked_counts(df, "v", bucket_values=100)
    assert max(r["cum"] for r in total.collect()) == sum(v is not None for _, v in data)


def test_exact_quantiles_interpolate(rows):
    df = rows([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 4.0), ("b", None)], "g string, v double")
    got = {r["g"]: (r["lo"], r["hi"]) for r in exact_quantiles(df, "v", {"lo": 0.05, "hi": 0.95}, ["g"]).collect()}
    assert math.isclose(got["a"][0], 1.1) and math.isclose(got["a"][1], 9.2) and got["b"] == (4.0, 4.0)
    rng = random.Random(2)
    vals = [rng.gauss(0, 1) for _ in range(999)]
    many = rows([(v,) for v in vals], "v double")
    for size in (10**6, 50):
        q = exact_quantiles(many, "v", {"q": 0.3}, bucket_values=size).first()["q"]
        s = sorted(vals)
        pos = 0.3 * 998
        assert math.isclose(q, s[int(pos)] + (s[int(pos) + 1] - s[int(pos)]) * (pos - int(pos)))


def test_hash_rank_and_cutoff_agree(rows):
    df = rows([(i, "hot" if i % 10 else "cold") for i in range(500)], "id bigint, c string").repartition(7)
    for digits in (1, 2, 4):
        ranked = hash_rank(df, "id", ["c"], 3, digits=digits)
        by_class = {}
        for r in ranked.collect():
            by_class.setdefault(r["c"], {})[r["rank"]] = r["id"]
        assert {c: sorted(v) for c, v in by_class.items()} == {"hot": list(range(1, 451)), "cold": list(range(1, 51))}
        keyed = {r["id"]: r["h"] for r in df.select("id", md5_key(3, F.col("id")).alias("h")).collect()}
        hot = [by_class["hot"][k] for k in range(1, 451)]
        assert hot == sorted(hot, key=lambda i: (keyed[i], i))
        cut = {r["c"]: r["cut_id"] for r in hash_cutoff(df, "id", ["c"], 3, 0.6, digits=digits).collect()}
        assert cut == {"hot": by_class["hot"][270], "cold": by_class["cold"][30]}


def test_splits_of_a_large_group_do_not_bring_its_rows_together(spark, monkeypatch):
    """Where a group's values are cut, the rows meet the list of large groups by a broadcast at any setting."""
    from pairlens.functions.ranking import ranked_counts

    kind = type(spark.range(1))
    plans, join = [], kind.join

    def watched(left, right, on=None, how=None):
        out = join(left, right, on, how)
        if how == "left_semi":
            plans.append(out._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(kind, "join", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", float(i % 50)) for i in range(300)] + [("b", 1.0)], "g string, x double")
        got = {(r["g"], r["x"]): (r["cnt"], r["cum"]) for r in ranked_counts(df, "x", ["g"], bucket_values=10).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {("a", float(i)): (6, 6 * i + 6) for i in range(50)} | {("b", 1.0): (1, 1)}
    assert plans and all("BroadcastHashJoin" in p for p in plans)
