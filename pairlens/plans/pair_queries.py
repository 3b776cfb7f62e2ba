"""Pair universe, events between pairs, pair attributes and directions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import pairs as P
from ..operators.spells import expand_spells, ordered_max, time_since
from . import inputs as I
from .catalog import query

_PAIRS = f"WITH {I.MARKETS_SQL}"
_PAIR_EVENTS = f"WITH {I.MARKETS_SQL}, {I.EVENTS_SQL}"


@query("y1_make_pairs", _PAIRS + " SELECT a_unit, b_unit, year FROM pairs")
def y1_make_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return I.market_pairs(spark, sf)


@query(
    "y1_make_pairs_text",
    f"""WITH {I.MARKETS_SQL}, u AS (SELECT DISTINCT CAST(unit AS VARCHAR) AS u, year FROM market_years)
        SELECT a.u AS a_unit, b.u AS b_unit, a.year AS year FROM u a JOIN u b ON a.year = b.year AND a.u < b.u""",
)
def y1_make_pairs_text(spark: SparkSession, sf: str) -> DataFrame:
    return P.make_pairs(I.market_years(spark, sf), "unit", "year", order="text")


@query(
    "y2_attach_sides",
    _PAIRS
    + """ SELECT p.*, a.total AS A_total, a.quantity AS A_quantity, b.total AS B_total, b.quantity AS B_quantity
          FROM pairs p JOIN market_years a ON a.unit = a_unit AND a.year = p.year
          JOIN market_years b ON b.unit = b_unit AND b.year = p.year""",
)
def y2_attach_sides(spark: SparkSession, sf: str) -> DataFrame:
    panel = I.stored_market_years(spark, sf)
    return P.attach_sides(P.make_pairs(panel, "unit", "year"), panel, ["total", "quantity"], "unit", "year")


@query("y3_event_pairs", _PAIR_EVENTS + ' SELECT event, attacker, target, "start", "end" FROM events')
def y3_event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return I.events(spark, sf)


_ONSETS = """
onsets AS (SELECT DISTINCT attacker, target, "start" AS year FROM events),
flags AS (SELECT p.*, CAST(x.attacker IS NOT NULL AS INTEGER) AS A_attacked, CAST(z.attacker IS NOT NULL AS INTEGER) AS B_attacked
          FROM pairs p LEFT JOIN onsets x ON x.attacker = a_unit AND x.target = b_unit AND x.year = p.year
          LEFT JOIN onsets z ON z.attacker = b_unit AND z.target = a_unit AND z.year = p.year)"""


@query("y4_onset_flags", f"{_PAIR_EVENTS}, {_ONSETS} SELECT * FROM flags")
def y4_onset_flags(spark: SparkSession, sf: str) -> DataFrame:
    return P.onset_flags(I.market_pairs(spark, sf), I.events(spark, sf), "year")


def _ongoing_sql(name: str, extra: int) -> str:
    return f"""{name} AS (
      SELECT DISTINCT least(attacker, target) AS a_unit, greatest(attacker, target) AS b_unit,
             CAST(unnest(generate_series("start", "end" + {extra})) AS INTEGER) AS year FROM events)"""


@query(
    "y5_ongoing_flag",
    f"""{_PAIR_EVENTS}, {_ongoing_sql("o", 0)}
        SELECT p.*, CAST(o.year IS NOT NULL AS INTEGER) AS ud_ongoing FROM pairs p LEFT JOIN o USING (a_unit, b_unit, year)""",
)
def y5_ongoing_flag(spark: SparkSession, sf: str) -> DataFrame:
    return P.ongoing_flag(I.market_pairs(spark, sf), I.events(spark, sf), "year")


@query(
    "y6_recent_event_flag",
    f"""{_PAIR_EVENTS}, {_ongoing_sql("o", 10)}
        SELECT p.*, CAST(o.year IS NOT NULL AS INTEGER) AS ud_recent FROM pairs p LEFT JOIN o USING (a_unit, b_unit, year)""",
)
def y6_recent_event_flag(spark: SparkSession, sf: str) -> DataFrame:
    return P.ongoing_flag(I.market_pairs(spark, sf), I.events(spark, sf), "year", "ud_recent", horizon=10, clamp=I.YEARS)


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    """Events started by each side, keyed in the wrong order for every other pair."""
    lo, hi = F.least("attacker", "target"), F.greatest("attacker", "target")
    sums = I.events(spark, sf).groupBy(lo.alias("lo"), hi.alias("hi"), F.col("start").alias("year")).agg(
        F.count(F.when(F.col("attacker") < F.col("target"), 1)).alias("by_lo"),
        F.count(F.when(F.col("attacker") > F.col("target"), 1)).alias("by_hi"),
        F.max(F.col("end") - F.col("start")).alias("longest"),
    )
    turn = (F.col("lo") + F.col("hi")) % 2 == 1
    return sums.select(
        F.when(turn, F.col("hi")).otherwise(F.col("lo")).alias("mem1"),
        F.when(turn, F.col("lo")).otherwise(F.col("hi")).alias("mem2"),
        "year",
        F.when(turn, F.col("by_hi")).otherwise(F.col("by_lo")).alias("flow1"),
        F.when(turn, F.col("by_lo")).otherwise(F.col("by_hi")).alias("flow2"),
        "longest",
    )


_FLOWS = """
flows AS (SELECT least(attacker, target) AS a_unit, greatest(attacker, target) AS b_unit, "start" AS year,
                 count(CASE WHEN attacker < target THEN 1 END) AS by_lo, count(CASE WHEN attacker > target THEN 1 END) AS by_hi,
                 max("end" - "start") AS longest
          FROM events GROUP BY 1, 2, 3)"""


@query(
    "y7_pair_attributes",
    f"""{_PAIR_EVENTS}, {_FLOWS}
        SELECT p.*, by_lo AS A_flow, by_hi AS B_flow, coalesce(longest, 0) AS ud_longest,
               CAST(by_lo IS NOT NULL AS INTEGER) AS ud_linked
        FROM pairs p LEFT JOIN flows USING (a_unit, b_unit, year)""",
)
def y7_pair_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return P.pair_attributes(
        I.market_pairs(spark, sf),
        _flows(spark, sf),
        "mem1",
        "mem2",
        "year",
        sided={"flow": ("flow1", "flow2")},
        shared={"ud_longest": "longest"},
        present="ud_linked",
        fill={"ud_longest": 0},
    )


@query(
    "y7_pair_attributes_as_keyed",
    f"""{_PAIR_EVENTS}, {_FLOWS}
        SELECT p.*, by_lo AS A_flow, by_hi AS B_flow
        FROM pairs p LEFT JOIN (SELECT * FROM flows WHERE (a_unit + b_unit) % 2 = 0) USING (a_unit, b_unit, year)""",
)
def y7_pair_attributes_as_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return P.pair_attributes(
        I.market_pairs(spark, sf),
        _flows(spark, sf),
        "mem1",
        "mem2",
        "year",
        sided={"flow": ("flow1", "flow2")},
        canonicalize=False,
    )


@query(
    "y8_directed_membership",
    f"""{_PAIR_EVENTS}, claims AS (SELECT DISTINCT attacker, target, "start" AS year FROM events WHERE "end" > "start")
        SELECT p.*, CAST(EXISTS (SELECT 1 FROM claims c WHERE c.attacker = a_unit AND c.target = b_unit AND c.year = p.year) AS INTEGER) AS A_claim,
               CAST(EXISTS (SELECT 1 FROM claims c WHERE c.attacker = b_unit AND c.target = a_unit AND c.year = p.year) AS INTEGER) AS B_claim
        FROM pairs p""",
)
def y8_directed_membership(spark: SparkSession, sf: str) -> DataFrame:
    claims = I.events(spark, sf).where(F.col("end") > F.col("start")).withColumnRenamed("start", "year")
    return P.directed_membership(I.market_pairs(spark, sf), claims, "attacker", "target", "year", ("A_claim", "B_claim"))


@query(
    "y9_pair_static_lookup",
    f"""WITH ny AS ({I.NATION_YEARS_SQL}),
        np AS (SELECT a.nation AS a_unit, b.nation AS b_unit, a.year AS year FROM ny a JOIN ny b ON a.year = b.year AND a.nation < b.nation),
        dist AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b,
                        CASE WHEN a.n_regionkey = b.n_regionkey THEN 0 ELSE 100.0::DOUBLE * abs(a.n_nationkey - b.n_nationkey) END AS km
                 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
                 WHERE a.n_nationkey NOT IN (3, 7) AND b.n_nationkey NOT IN (3, 7)),
        sub AS (SELECT *, CASE a_unit WHEN 3 THEN 4 WHEN 7 THEN 8 ELSE a_unit END AS sa,
                       CASE b_unit WHEN 3 THEN 4 WHEN 7 THEN 8 ELSE b_unit END AS sb FROM np),
        found AS (SELECT s.a_unit, s.b_unit, s.year, coalesce(d.km, e.km) AS km FROM sub s
                  LEFT JOIN dist d ON d.a = a_unit AND d.b = b_unit
                  LEFT JOIN dist e ON e.a = least(sa, sb) AND e.b = greatest(sa, sb))
        SELECT a_unit, b_unit, year, CASE WHEN a_unit = 1 AND b_unit = 2 THEN 1 WHEN km = 0 THEN 8 ELSE km END AS ud_distance FROM found""",
)
def y9_pair_static_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nation = I.table(spark, sf, "nation").where("n_nationkey NOT IN (3, 7)")
    # All pairs of nations are pairs of one single period.
    one = nation.select("n_nationkey", "n_regionkey", F.lit(0).alias("era"))
    both = P.attach_sides(P.make_pairs(one, "n_nationkey", "era"), one, ["n_regionkey"], "n_nationkey", "era")
    apart = F.lit(100.0) * F.abs(F.col("a_unit") - F.col("b_unit"))
    km = F.when(F.col("A_n_regionkey") == F.col("B_n_regionkey"), 0.0).otherwise(apart)
    table = both.select("a_unit", "b_unit", km.alias("km"))
    return P.pair_static_lookup(
        P.make_pairs(I.nation_years(spark, sf), "nation", "year"),
        table,
        "a_unit",
        "b_unit",
        "km",
        "ud_distance",
        substitutes=spark.createDataFrame([(3, 4), (7, 8)], "code int, substitute int"),
        zero_value=8.0,
        overrides=spark.createDataFrame([(1, 2, 1.0)], "a_unit int, b_unit int, km double"),
    )


@query(
    "y10_mirror_pairs",
    f"""{_PAIR_EVENTS}, {_ONSETS},
        w AS (SELECT f.*, a.total AS A_total, b.total AS B_total, (f.a_unit + f.b_unit) % 7 AS ud_group FROM flags f
              JOIN market_years a ON a.unit = a_unit AND a.year = f.year JOIN market_years b ON b.unit = b_unit AND b.year = f.year)
        SELECT a_unit, b_unit, year, A_attacked, B_attacked, A_total, B_total, ud_group FROM w UNION ALL
        SELECT b_unit, a_unit, year, B_attacked, A_attacked, B_total, A_total, ud_group FROM w""",
)
def y10_mirror_pairs(spark: SparkSession, sf: str) -> DataFrame:
    panel = I.stored_market_years(spark, sf)
    flags = P.onset_flags(P.make_pairs(panel, "unit", "year"), I.events(spark, sf), "year")
    wide = P.attach_sides(flags, panel, ["total"], "unit", "year")
    return P.mirror_pairs(wide.withColumn("ud_group", (F.col("a_unit") + F.col("b_unit")) % 7))


def pair_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected pair-years with sides, event flags and time since the last event."""
    panel = I.stored_market_years(spark, sf)
    frame = P.make_pairs(panel, "unit", "year")
    frame = P.event_flags(frame, I.events(spark, sf), "year", {"ud_ongoing": 0, "ud_recent": 10}, clamp=I.YEARS)
    frame = time_since(frame, list(P.PAIR), "year", "ud_ongoing", "ud_quiet")
    return P.attach_sides(frame, panel, ["total", "quantity"], "unit", "year")


PAIR_FRAME_SQL = f"""
{_ONSETS}, {_ongoing_sql("now_on", 0)}, {_ongoing_sql("recent", 10)},
marked AS (SELECT f.*, CAST(o.year IS NOT NULL AS INTEGER) AS ud_ongoing, CAST(r.year IS NOT NULL AS INTEGER) AS ud_recent
           FROM flags f LEFT JOIN now_on o USING (a_unit, b_unit, year) LEFT JOIN recent r USING (a_unit, b_unit, year)),
steps AS (SELECT *, CASE WHEN ud_ongoing = 1 OR year <> lag(year) OVER (PARTITION BY a_unit, b_unit ORDER BY year) + 1 THEN 1 ELSE 0 END AS reset FROM marked),
isl AS (SELECT *, sum(reset) OVER (PARTITION BY a_unit, b_unit ORDER BY year ROWS UNBOUNDED PRECEDING) AS island FROM steps),
quiet AS (SELECT * EXCLUDE (reset, island), CAST(row_number() OVER (PARTITION BY a_unit, b_unit, island ORDER BY year)
                 - CASE WHEN island = 0 THEN 0 ELSE 1 END AS INTEGER) AS ud_quiet FROM isl),
pair_frame AS (SELECT q.*, a.total AS A_total, a.quantity AS A_quantity, b.total AS B_total, b.quantity AS B_quantity FROM quiet q
               JOIN market_years a ON a.unit = a_unit AND a.year = q.year JOIN market_years b ON b.unit = b_unit AND b.year = q.year)"""


@query(
    "pair_panel",
    f"""{_PAIR_EVENTS}, {PAIR_FRAME_SQL}
        SELECT year, count(*) AS n_pairs, CAST(sum(A_attacked) AS BIGINT) AS a_onsets, CAST(sum(B_attacked) AS BIGINT) AS b_onsets,
               CAST(sum(ud_ongoing) AS BIGINT) AS ongoing, CAST(sum(ud_recent) AS BIGINT) AS recent,
               round(avg(ud_quiet), 6) AS mean_quiet, round(sum(A_total + B_total), 2) AS total
        FROM pair_frame GROUP BY 1""",
)
def pair_panel(spark: SparkSession, sf: str) -> DataFrame:
    return pair_frame(spark, sf).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum("A_attacked").alias("a_onsets"),
        F.sum("B_attacked").alias("b_onsets"),
        F.sum("ud_ongoing").alias("ongoing"),
        F.sum("ud_recent").alias("recent"),
        F.round(F.avg("ud_quiet"), 6).alias("mean_quiet"),
        F.round(F.sum(F.col("A_total") + F.col("B_total")), 2).alias("total"),
    )


@query(
    "pair_levels",
    f"""{_PAIR_EVENTS},
        spells AS (SELECT least(attacker, target) AS a_unit, greatest(attacker, target) AS b_unit, "start", "end",
                          CASE WHEN "end" - "start" >= 2 THEN 3 WHEN "end" > "start" THEN 2 ELSE 1 END AS level FROM events),
        best AS (SELECT p.a_unit, p.b_unit, p.year, max(level) AS level FROM pairs p
                 JOIN spells s ON s.a_unit = p.a_unit AND s.b_unit = p.b_unit AND p.year BETWEEN "start" AND "end" GROUP BY ALL)
        SELECT a_unit, b_unit, year, CASE coalesce(level, 0) WHEN 3 THEN 'long' WHEN 2 THEN 'short' WHEN 1 THEN 'brief' ELSE 'none' END AS closeness
        FROM pairs LEFT JOIN best USING (a_unit, b_unit, year)""",
)
def pair_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Spells with levels on pairs: several may hold at once, the closest counts, pairs with none get the lowest."""
    events = I.events(spark, sf)
    length = F.col("end") - F.col("start")
    spells = events.select(
        F.least("attacker", "target").alias("a_unit"),
        F.greatest("attacker", "target").alias("b_unit"),
        "start",
        "end",
        F.when(length >= 2, 3).when(length > 0, 2).otherwise(1).alias("level"),
    )
    years = expand_spells(spells, "start", "end", "year", clamp=I.YEARS)
    levels = spark.createDataFrame([(0, "none", 0), (1, "brief", 1), (2, "short", 2), (3, "long", 3)], "code int, label string, rank int")
    return ordered_max(years, ["a_unit", "b_unit", "year"], "level", levels, "closeness", I.market_pairs(spark, sf))


def supplier_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of suppliers that share an order with two large lines, by the year of the order."""
    big = I.order_lines(spark, sf).where("l_quantity >= 49").select("l_orderkey", F.col("l_suppkey").alias("unit"), I.year_of("o_orderdate").alias("year"))
    a, b = big.withColumnRenamed("unit", "a_unit"), big.withColumnRenamed("unit", "b_unit")
    return a.join(b, ["l_orderkey", "year"]).where("a_unit < b_unit").select(*P.PAIR, "year").distinct()


@query(
    "y1_case_control_pairs",
    f"""WITH u AS (SELECT suppkey AS unit, year FROM ({I.SUPPLIER_YEARS_SQL})),
        r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5('90210:' || unit), unit) - 1 AS k FROM u),
        n AS (SELECT year, count(*) AS n FROM u GROUP BY 1),
        off AS (SELECT year, n * (n - 1) // 2 AS pairs, coalesce(sum(n * (n - 1) // 2) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n),
        big AS (SELECT l_orderkey, l_suppkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 49),
        c AS (SELECT DISTINCT a.unit AS a_unit, b.unit AS b_unit, a.year AS year FROM big a JOIN big b ON a.l_orderkey = b.l_orderkey AND a.unit < b.unit),
        n1 AS (SELECT count(*) AS n1 FROM c), tot AS (SELECT CAST(sum(pairs) AS BIGINT) AS total FROM off),
        d AS (SELECT id, {I.draw_sql("90210:pair", "id")} % total AS g FROM (SELECT unnest(range(0, 60 * n1 + 1000)) AS id FROM n1), tot),
        p AS (SELECT id, year, CAST(g - start AS BIGINT) AS x FROM d JOIN off ON g >= start AND g < start + pairs),
        q AS (SELECT id, year, x, j - CASE WHEN j * (j - 1) // 2 > x THEN 1 ELSE 0 END AS j
              FROM (SELECT *, CAST(floor((sqrt(8.0::DOUBLE * x + 1) + 1) / 2) AS BIGINT) AS j FROM p)),
        h AS (SELECT id, q.year, least(s.unit, t.unit) AS a_unit, greatest(s.unit, t.unit) AS b_unit
              FROM q JOIN r s ON s.year = q.year AND s.k = x - j * (j - 1) // 2 JOIN r t ON t.year = q.year AND t.k = j),
        kept AS (SELECT *, row_number() OVER (ORDER BY id) AS nth FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.a_unit = h.a_unit AND c.b_unit = h.b_unit AND c.year = h.year)),
        cr AS (SELECT *, row_number() OVER (ORDER BY md5('90210:' || a_unit || ':' || b_unit || ':' || year), a_unit || ':' || b_unit || ':' || year) AS k FROM c),
        cd AS (SELECT {I.draw_sql("90210:case", "id")} % n1 + 1 AS k FROM (SELECT unnest(range(0, n1)) AS id, n1 FROM n1))
        SELECT a_unit, b_unit, year, 0 AS label, count(*) AS n_draws FROM kept, n1 WHERE nth <= 20 * n1 GROUP BY ALL
        UNION ALL SELECT a_unit, b_unit, year, 1, count(*) FROM cd JOIN cr USING (k) GROUP BY ALL""",
)
def y1_case_control_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cases and twenty controls each, of all pairs of suppliers that sold in the same year."""
    return P.case_control_pairs(I.supplier_years(spark, sf), "suppkey", "year", supplier_cases(spark, sf), ratio=20)
