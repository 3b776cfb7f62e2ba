"""Sources, code conformance, cleaning, spells and panel variables on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clean, codes, spells
from ..session import scratch_path
from ..sources import read_replicate, read_source, write_replicates
from . import inputs as I
from .catalog import query

# --- sources and sinks -----------------------------------------------------------------


@query(
    "s1_read_source_csv",
    """SELECT s_suppkey, s_name, CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS s_nationkey,
              CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal
       FROM supplier""",
)
def s1_read_source_csv(spark: SparkSession, sf: str) -> DataFrame:
    coded = I.table(spark, sf, "supplier").select(
        "s_suppkey",
        "s_name",
        F.when(F.col("s_nationkey") == 3, "-9").otherwise(F.col("s_nationkey").cast("string")).alias("s_nationkey"),
        F.when(F.col("s_acctbal") < 0, "-9").otherwise(F.col("s_acctbal").cast("string")).alias("s_acctbal"),
    )
    path = scratch_path(spark, "csv")
    coded.write.csv(path, header=False)
    schema = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
    return read_source(spark, path, schema, "csv", header=False, na_values=["-9"])


@query("s1_read_source_columns", "SELECT r_regionkey, CASE WHEN r_name <> 'REGION_1' THEN r_name END AS r_name FROM region")
def s1_read_source_columns(spark: SparkSession, sf: str) -> DataFrame:
    return read_source(spark, f"{sf}/region.parquet", na_values=["REGION_1"], columns=["r_regionkey", "r_name"])


def _replicated(spark: SparkSession, sf: str) -> str:
    reps = I.supplier_years(spark, sf).withColumns(
        {"imp_i": F.explode(F.sequence(F.lit(1), F.lit(3))), "imp_j": F.explode(F.sequence(F.lit(1), F.lit(2)))}
    )
    path = scratch_path(spark, "replicates")
    write_replicates(reps.withColumn("lines", F.col("lines") * F.col("imp_i") + F.col("imp_j")), path)
    return path


_REPLICATED_SQL = f"""
WITH r AS (SELECT suppkey, year, quantity, lines * i + j AS lines, i AS imp_i, j AS imp_j
           FROM ({I.SUPPLIER_YEARS_SQL}), (VALUES (1), (2), (3)) a(i), (VALUES (1), (2)) b(j))"""


@query(
    "s2_write_replicates",
    _REPLICATED_SQL
    + """ SELECT CAST(imp_i AS INTEGER) AS imp_i, CAST(imp_j AS INTEGER) AS imp_j, count(*) AS n,
                CAST(sum(lines) AS BIGINT) AS lines FROM r GROUP BY ALL""",
)
def s2_write_replicates(spark: SparkSession, sf: str) -> DataFrame:
    stored = spark.read.parquet(_replicated(spark, sf))
    return stored.groupBy("imp_i", "imp_j").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"))


@query("s3_read_replicate", _REPLICATED_SQL + " SELECT suppkey, year, quantity, lines FROM r WHERE imp_i = 2 AND imp_j = 1")
def s3_read_replicate(spark: SparkSession, sf: str) -> DataFrame:
    one = read_replicate(spark, _replicated(spark, sf), imp_i=2, imp_j=1)
    return one.select("suppkey", "year", "quantity", "lines")


# --- code conformance --------------------------------------------------------------------


def _nation_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation is valid as itself; 3 becomes 4 from 1998, 7 is not valid before 1996."""
    key = F.col("n_nationkey")
    first = F.when(key == 7, 1996).otherwise(0)
    last = F.when(key == 3, 1997).otherwise(9999)
    same = I.table(spark, sf, "nation").select(
        key.alias("raw_code"), first.alias("valid_from"), last.alias("valid_to"), key.alias("canonical_code")
    )
    return same.unionByName(
        spark.createDataFrame([(3, 1998, 9999, 4)], "raw_code int, valid_from int, valid_to int, canonical_code int")
    )


@query(
    "c1_conform_codes",
    f"""WITH ny AS ({I.NATION_YEARS_SQL}),
        mapped AS (SELECT CASE WHEN nation = 3 AND year >= 1998 THEN 4 ELSE nation END AS nation, year, total, n_orders
                   FROM ny WHERE NOT (nation = 7 AND year < 1996))
        SELECT nation, year, nation || '_' || year AS unit_year, round(sum(total), 2) AS total,
               CAST(sum(n_orders) AS BIGINT) AS n_orders, count(*) AS n_sources
        FROM mapped GROUP BY ALL""",
)
def c1_conform_codes(spark: SparkSession, sf: str) -> DataFrame:
    conformed = codes.conform_codes(
        I.nation_years(spark, sf), "nation", "year", _nation_mapping(spark, sf), key_name="unit_year"
    )
    return conformed.groupBy("nation", "year", "unit_year").agg(
        I.money("total").alias("total"), F.sum("n_orders").alias("n_orders"), F.count(F.lit(1)).alias("n_sources")
    )


@query(
    "c1_conform_codes_keep_invalid",
    f"""SELECT CASE WHEN nation = 3 AND year >= 1998 THEN 4 WHEN nation = 7 AND year < 1996 THEN NULL ELSE nation END AS nation,
               year, total, n_orders FROM ({I.NATION_YEARS_SQL})""",
)
def c1_conform_codes_keep_invalid(spark: SparkSession, sf: str) -> DataFrame:
    return codes.conform_codes(I.nation_years(spark, sf), "nation", "year", _nation_mapping(spark, sf), drop_invalid=False)


@query(
    "c2_group_filter",
    """SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
       WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1
                            HAVING max(l_quantity) >= 45 AND min(l_discount) > 0)
       GROUP BY 1""",
)
def c2_group_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = codes.group_filter(
        I.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount"),
        "l_orderkey",
        any_=F.col("l_quantity") >= 45,
        none_=F.col("l_discount") == 0,
    )
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


# --- cleaning, patching, audits ------------------------------------------------------------


def _with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    lines = I.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_tax", "l_discount")
    return clean.sentinel_to_null(lines, ["l_tax", "l_discount"], 0.0)


_GAPS_SQL = "g AS (SELECT l_orderkey, l_returnflag, l_quantity, nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM lineitem)"


@query(
    "d1_sentinel_to_null",
    f"""WITH {_GAPS_SQL} SELECT l_returnflag, count(*) AS n, count(l_tax) AS n_tax, count(l_discount) AS n_discount,
        round(avg(l_tax), 6) AS tax, round(avg(l_discount), 6) AS discount FROM g GROUP BY 1""",
)
def d1_sentinel_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return _with_gaps(spark, sf).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("l_tax").alias("n_tax"),
        F.count("l_discount").alias("n_discount"),
        F.round(F.avg("l_tax"), 6).alias("tax"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
    )


@query(
    "d2_recode_special",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN o_totalprice WHEN 'F' THEN o_totalprice ELSE 1 END AS score
       FROM orders""",
)
def d2_recode_special(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "P", -77.0).when(F.col("o_orderstatus") == "F", -88.0).otherwise(1.0)
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", state.alias("score"))
    return clean.recode_special(orders, "score", [-66.0, -77.0, -88.0], "o_totalprice").select("o_orderkey", "score")


@query(
    "d3_patch_rows",
    f"""WITH ny AS ({I.NATION_YEARS_SQL}),
        patch AS (SELECT 5 AS nation, CAST(y AS INTEGER) AS year, 1.5::DOUBLE AS total, 1::BIGINT AS n_orders FROM range(1993, 1997) t(y)
                  UNION ALL SELECT 6, 2000, 2.5, 2),
        patched AS (SELECT * FROM ny WHERE (nation, year) NOT IN (SELECT nation, year FROM patch) UNION ALL SELECT * FROM patch)
        SELECT * FROM patched UNION ALL SELECT 30, year, total, n_orders FROM patched WHERE nation = 3""",
)
def d3_patch_rows(spark: SparkSession, sf: str) -> DataFrame:
    ranges = spark.createDataFrame(
        [(5, 1.5, 1, 1993, 1996), (6, 2.5, 2, 2000, 2000)], "nation int, total double, n_orders bigint, y0 int, y1 int"
    )
    patch = clean.expand_ranges(ranges, "y0", "y1", "year")
    patched = clean.patch_rows(I.nation_years(spark, sf), patch, ["nation", "year"])
    return clean.clone_rows(patched, F.col("nation") == 3, {"nation": F.lit(30)}, ["nation", "year"])


@query(
    "d4_patch_values",
    """SELECT p_partkey, CASE WHEN p_size = 50 THEN 999 ELSE p_retailprice END AS p_retailprice,
              CASE WHEN p_size = 50 AND p_type <> 'PROMO' THEN 'none' ELSE p_brand END AS p_brand
       FROM part""",
)
def d4_patch_values(spark: SparkSession, sf: str) -> DataFrame:
    part = I.table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_brand", "p_size", "p_type")
    patch = part.where("p_size = 50").select(
        "p_partkey", F.lit(999.0).alias("p_retailprice"), F.when(F.col("p_type") != "PROMO", "none").alias("p_brand")
    )
    out = clean.patch_values(part.drop("p_size", "p_type"), patch, "p_partkey", ["p_retailprice", "p_brand"])
    return out.select("p_partkey", "p_retailprice", "p_brand")


@query(
    "d5_drop_ineligible",
    f"""SELECT * FROM ({I.NATION_YEARS_SQL})
        WHERE nation <> 7 AND NOT (nation = 3 AND year <= 1996) AND NOT (nation = 11 AND year BETWEEN 1998 AND 1999)""",
)
def d5_drop_ineligible(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(
        [(7, None, None), (3, None, 1996), (11, 1998, 1999)], "nation int, drop_from int, drop_to int"
    )
    return clean.drop_ineligible(I.nation_years(spark, sf), rules, "nation", "year")


@query(
    "d6_fill_defaults",
    f"""WITH {_GAPS_SQL},
        f AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN coalesce(l_tax, 0.05) ELSE l_tax END AS l_tax,
                     coalesce(l_discount, 0.5) AS l_discount FROM g)
        SELECT l_returnflag, count(l_tax) AS n_tax, round(sum(l_tax), 2) AS tax, round(sum(l_discount), 2) AS discount
        FROM f GROUP BY 1""",
)
def d6_fill_defaults(spark: SparkSession, sf: str) -> DataFrame:
    some = clean.fill_defaults(_with_gaps(spark, sf), {"l_tax": 0.05}, F.col("l_returnflag") == "R")
    filled = clean.fill_defaults(some, {"l_discount": 0.5})
    return filled.groupBy("l_returnflag").agg(
        F.count("l_tax").alias("n_tax"), I.money("l_tax").alias("tax"), I.money("l_discount").alias("discount")
    )


@query(
    "d7_keep_first",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                      ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
       WHERE k = 1""",
)
def d7_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    lines = I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity"
    )
    return clean.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])


@query(
    "d7_duplicate_audit",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def d7_duplicate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return clean.duplicate_audit(I.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "d8_coverage_audit",
    """SELECT c_custkey, min(c_name) AS c_name, min(y) AS first_missing, max(y) AS last_missing, count(*) AS n_missing
       FROM customer, (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS y)
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y)
       GROUP BY 1""",
)
def d8_coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    universe = I.table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.explode(F.sequence(F.lit(I.YEARS[0]), F.lit(I.YEARS[1]))).alias("year")
    )
    seen = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), I.year_of("o_orderdate").alias("year"))
    return clean.coverage_audit(universe, seen, ["c_custkey", "year"], "c_custkey", "year", "c_name")


@query(
    "d9_missing_profile",
    f"""WITH {_GAPS_SQL} SELECT 'l_tax' AS "column", round(avg(CASE WHEN l_tax IS NULL THEN 1.0::DOUBLE ELSE 0 END), 3) * 100 AS pct_missing FROM g
        UNION ALL SELECT 'l_discount', round(avg(CASE WHEN l_discount IS NULL THEN 1.0::DOUBLE ELSE 0 END), 3) * 100 FROM g
        UNION ALL SELECT 'l_quantity', round(avg(CASE WHEN l_quantity IS NULL THEN 1.0::DOUBLE ELSE 0 END), 3) * 100 FROM g""",
)
def d9_missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return clean.missing_profile(_with_gaps(spark, sf), ["l_tax", "l_discount", "l_quantity"])


@query(
    "d10_complete_cases",
    f"""WITH {_GAPS_SQL} SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM g
        WHERE l_tax IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1""",
)
def d10_complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    kept = clean.complete_cases(_with_gaps(spark, sf))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


# --- spells and panel variables --------------------------------------------------------------


@query(
    "e1_enrich",
    f"""SELECT sy.suppkey, year, total, s_nationkey AS nation, n_regionkey AS region
        FROM ({I.SUPPLIER_YEARS_SQL}) sy LEFT JOIN supplier ON s_suppkey = sy.suppkey
        LEFT JOIN nation ON n_nationkey = s_nationkey""",
)
def e1_enrich(spark: SparkSession, sf: str) -> DataFrame:
    supplier = I.table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "suppkey")
    nation = I.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "nation")
    panel = I.supplier_years(spark, sf).select("suppkey", "year", "total")
    named = spells.enrich(panel, supplier, "suppkey", ["s_nationkey"], {"s_nationkey": "nation"})
    out = spells.enrich(named, nation, "nation", ["n_regionkey"], {"n_regionkey": "region"})
    return out.select("suppkey", "year", "total", "nation", "region")


def _order_spells(spark: SparkSession, sf: str) -> DataFrame:
    """Order month to last ship month per order."""
    lines = I.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    return I.table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", I.month_index("o_orderdate").alias("start"), I.month_index("shipped").alias("end")
    )


@query(
    "e2_expand_spells",
    """WITH s AS (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS a,
                         max(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS b
                  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate),
            m AS (SELECT o_orderkey, unnest(generate_series(greatest(a, 1996 * 12), least(b, 2000 * 12 + 11))) AS period
                  FROM s WHERE a <= b)
       SELECT CAST(period AS INTEGER) AS period, count(*) AS n_open, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
       FROM m GROUP BY 1""",
)
def e2_expand_spells(spark: SparkSession, sf: str) -> DataFrame:
    months = spells.expand_spells(_order_spells(spark, sf), "start", "end", clamp=(1996 * 12, 2000 * 12 + 11))
    return months.groupBy("period").agg(F.count(F.lit(1)).alias("n_open"), F.sum("o_orderkey").alias("key_sum"))


def _supplier_spells(spark: SparkSession, sf: str, unit_of_time) -> DataFrame:
    return I.order_lines(spark, sf).select(
        F.col("l_suppkey").alias("suppkey"), unit_of_time("o_orderdate").alias("start"), unit_of_time("l_shipdate").alias("end")
    )


@query(
    "e3_spell_flag",
    """WITH s AS (SELECT DISTINCT l_suppkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS a,
                         year(l_shipdate) * 12 + month(l_shipdate) - 1 AS b
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
            p AS (SELECT s_suppkey AS suppkey, CAST(unnest(range(1995 * 12, 2002 * 12)) AS INTEGER) AS month FROM supplier)
       SELECT suppkey, month, CAST(EXISTS (SELECT 1 FROM s WHERE l_suppkey = suppkey AND month BETWEEN a AND b) AS INTEGER) AS open
       FROM p""",
)
def e3_spell_flag(spark: SparkSession, sf: str) -> DataFrame:
    panel = I.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), F.explode(F.sequence(F.lit(1995 * 12), F.lit(2001 * 12 + 11))).alias("month")
    )
    lines = I.order_lines(spark, sf)
    ranges = lines.select(
        F.col("l_suppkey").alias("suppkey"), I.month_index("o_orderdate").alias("start"), I.month_index("l_shipdate").alias("end")
    )
    return spells.spell_open(panel, ranges, "suppkey", "month", "start", "end", "open")


@query(
    "e4_spell_count",
    f"""WITH s AS (SELECT l_suppkey, year(o_orderdate) AS a, year(l_shipdate) AS b
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
             r AS (SELECT l_suppkey, CASE WHEN b > a THEN a ELSE a - 1 END AS a, b - 1 AS b FROM s WHERE b >= a)
        SELECT suppkey, year, (SELECT count(*) FROM r WHERE l_suppkey = suppkey AND year BETWEEN a AND b) AS n_running
        FROM ({I.SUPPLIER_YEARS_SQL})""",
)
def e4_spell_count(spark: SparkSession, sf: str) -> DataFrame:
    panel = I.supplier_years(spark, sf).select("suppkey", "year")
    return spells.spell_count(
        panel, _supplier_spells(spark, sf, I.year_of), "suppkey", "year", "start", "end", "n_running"
    )


@query(
    "e5_state_flags",
    f"""WITH p AS (SELECT nation, year, CASE WHEN nation % 5 = 1 AND year = 1997 THEN -66
                          WHEN nation % 5 = 2 AND year = 1998 THEN -88 WHEN nation % 5 = 3 AND year = 1999 THEN NULL
                          ELSE CAST(n_orders % 20 AS INTEGER) END AS score FROM ({I.NATION_YEARS_SQL})),
             l AS (SELECT *, lag(score) OVER (PARTITION BY nation ORDER BY year) AS before FROM p)
        SELECT nation, year, CAST(score = -66 AS INTEGER) AS occupied,
               CASE WHEN coalesce(score IN (-77, -88), false) OR coalesce(abs(score - before) >= 3, false) THEN 1 ELSE 0 END AS unstable
        FROM l""",
)
def e5_state_flags(spark: SparkSession, sf: str) -> DataFrame:
    nation, year = F.col("nation"), F.col("year")
    score = (
        F.when((nation % 5 == 1) & (year == 1997), -66)
        .when((nation % 5 == 2) & (year == 1998), -88)
        .when((nation % 5 == 3) & (year == 1999), F.lit(None))
        .otherwise((F.col("n_orders") % 20).cast("int"))
    )
    panel = I.nation_years(spark, sf).select("nation", "year", score.alias("score"))
    flags = spells.state_flags(panel, "nation", "year", "score", -66, [-77, -88], 3, "occupied", "unstable")
    return flags.drop("score")


@query(
    "e6_resolve_primary",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE -8 END AS cand
                  FROM lineitem),
            o AS (SELECT l_orderkey, min(cand) AS pick FROM c WHERE cand <> -8 AND l_orderkey % 2 = 0 GROUP BY 1),
            t AS (SELECT c.*, pick, count(*) OVER g AS n, count(CASE WHEN cand <> -8 THEN 1 END) OVER g AS n_real
                  FROM c LEFT JOIN o USING (l_orderkey) WINDOW g AS (PARTITION BY l_orderkey)),
            k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, cand) AS r
                  FROM t WHERE n = 1 OR (n_real = 1 AND cand <> -8) OR (n_real <> 1 AND cand = pick))
       SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, cand FROM k WHERE r = 1""",
)
def e6_resolve_primary(spark: SparkSession, sf: str) -> DataFrame:
    cand = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).otherwise(F.lit(-8)).alias("cand")
    rows = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", cand)
    named = rows.where("cand <> -8 AND l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.min("cand").alias("cand"))
    return spells.resolve_primary(rows, "l_orderkey", "cand", -8, named, ["l_linenumber", "l_partkey", "l_quantity", "cand"])


PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


@query(
    "e7_ordered_max",
    """WITH m AS (SELECT o_custkey, year(o_orderdate) AS y, max(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS r
                  FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY ALL),
            u AS (SELECT c_custkey AS custkey, CAST(unnest(range(1995, 2002)) AS INTEGER) AS year FROM customer)
       SELECT custkey, year, CASE coalesce(r, 1) WHEN 1 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'urgent' END AS top
       FROM u LEFT JOIN m ON o_custkey = custkey AND y = year""",
)
def e7_ordered_max(spark: SparkSession, sf: str) -> DataFrame:
    levels = spark.createDataFrame(
        [("5-LOW", "low", 1), ("3-MEDIUM", "medium", 3), ("2-HIGH", "high", 4), ("1-URGENT", "urgent", 5)],
        "code string, label string, rank int",
    )
    orders = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), I.year_of("o_orderdate").alias("year"), "o_orderpriority"
    )
    universe = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.explode(F.sequence(F.lit(I.YEARS[0]), F.lit(I.YEARS[1]))).alias("year")
    )
    return spells.ordered_max(orders, ["custkey", "year"], "o_orderpriority", levels, "top", universe)


@query(
    "e8_time_since",
    f"""WITH p AS ({I.USER_DAYS_SQL}),
        r AS (SELECT *, CASE WHEN kill = 1 OR day <> lag(day) OVER (PARTITION BY user_id ORDER BY day) + 1 THEN 1 ELSE 0 END AS reset FROM p),
        i AS (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM r)
        SELECT user_id, day, kill, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY day)
               - CASE WHEN island = 0 THEN 0 ELSE 1 END AS INTEGER) AS since FROM i""",
)
def e8_time_since(spark: SparkSession, sf: str) -> DataFrame:
    days = I.user_days(spark, sf).select("user_id", "day", "kill")
    return spells.time_since(days, "user_id", "day", "kill", "since")


@query(
    "e9_lag_features",
    f"""SELECT user_id, day, lag(n) OVER w AS n_lag, lag(value) OVER w AS value_lag, lag(kill) OVER w AS kill_lag
        FROM ({I.USER_DAYS_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY day)""",
)
def e9_lag_features(spark: SparkSession, sf: str) -> DataFrame:
    lagged = spells.lag_features(I.user_days(spark, sf), "user_id", "day", ["n", "value", "kill"])
    return lagged.select("user_id", "day", "n_lag", "value_lag", "kill_lag")


# --- forms for large inputs ---------------------------------------------------------------------


@query(
    "e4_running_days",
    """WITH s AS (SELECT l_suppkey AS suppkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS a,
                         date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
            d AS (SELECT suppkey, a AS day, CASE WHEN a <= b THEN 1 ELSE 0 END AS change FROM s UNION ALL
                  SELECT suppkey, b + 1, CASE WHEN a <= b THEN -1 ELSE 0 END FROM s UNION ALL SELECT suppkey, b, 0 FROM s),
            r AS (SELECT suppkey, day, sum(sum(change)) OVER (PARTITION BY suppkey ORDER BY day) AS n FROM d GROUP BY 1, 2)
       SELECT s.suppkey, CAST(day AS BIGINT) AS day, CAST(any_value(n) AS BIGINT) AS n_running FROM s JOIN r ON r.suppkey = s.suppkey AND r.day = s.b
       GROUP BY 1, 2""",
)
def e4_running_days(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that a supplier has open on each day that one of them arrives; no spell is expanded into days."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    lines = I.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("suppkey"), day("l_shipdate").alias("end"))
    orders = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("start"))
    open_lines = lines.join(orders, "l_orderkey").select("suppkey", "start", "end")
    points = open_lines.select("suppkey", F.col("end").alias("day")).distinct()
    return spells.count_at(points, open_lines, "suppkey", "day", "start", "end", "n_running", span=365)


@query(
    "e2_running_spans",
    """WITH s AS (SELECT l_suppkey AS suppkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS a,
                         date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
       SELECT suppkey, CAST(sum(b - a + 1) AS BIGINT) AS spell_days, CAST(min(a) AS BIGINT) AS first, CAST(max(b) AS BIGINT) AS last
       FROM s WHERE a <= b GROUP BY 1""",
)
def e2_running_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of equal numbers of open lines add up to the days of all lines."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    lines = I.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("suppkey"), day("l_shipdate").alias("end"))
    orders = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("start"))
    spans = spells.running_spans(lines.join(orders, "l_orderkey"), "suppkey", "start", "end", span=365)
    days = (F.col("last") - F.col("first") + 1) * F.col("n")
    return spans.groupBy("suppkey").agg(F.sum(days).alias("spell_days"), F.min("first").alias("first"), F.max("last").alias("last"))


@query(
    "c1_conform_by_intervals",
    """SELECT o_orderkey, CAST(CASE WHEN day < 8400 + o_custkey * 37 % 2000 THEN o_custkey
              WHEN day <= 8400 + o_custkey * 37 % 2000 + 300 THEN NULL ELSE 1000000 + c_nationkey END AS BIGINT) AS custkey
       FROM (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders) LEFT JOIN customer ON c_custkey = o_custkey""",
)
def c1_conform_by_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Two intervals of every customer, with a gap of 300 days between them, joined to all orders by day."""
    c = I.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("raw_code"), "c_nationkey")
    turn = (F.col("raw_code") * 37 % 2000 + 8400).cast("long")
    one = F.struct(F.lit(0).cast("long").alias("valid_from"), (turn - 1).alias("valid_to"), F.col("raw_code").alias("canonical_code"))
    two = F.struct((turn + 301).alias("valid_from"), F.lit(10**6).cast("long").alias("valid_to"), (F.lit(1000000) + F.col("c_nationkey")).cast("long").alias("canonical_code"))
    mapping = c.select("raw_code", F.inline(F.array(one, two)))
    orders = I.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("long").alias("custkey"), F.unix_date(F.col("o_orderdate").cast("date")).alias("day")
    )
    return codes.conform_by_intervals(orders, "custkey", "day", mapping, drop_invalid=False).select("o_orderkey", "custkey")
