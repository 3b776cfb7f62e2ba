"""Scaling, priors and imputation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import mask_draw
from ..functions.expressions import ERF_A, ERF_P
from ..operators import scaling as S
from ..operators.imputation import em_impute
from . import inputs as I
from .catalog import query


def phi_sql(z: str) -> str:
    """Normal distribution function, the same published approximation written as SQL."""
    t = f"(1.0::DOUBLE / (1 + {ERF_P}::DOUBLE * abs({z}) / sqrt(2.0::DOUBLE)))"
    poly = " + ".join(f"({a}::DOUBLE) * pow({t}, {k})" for k, a in enumerate(ERF_A, 1))
    return f"0.5::DOUBLE * (1 + sign({z}) * (1 - ({poly}) * exp(-({z}) * ({z}) / 2)))"


def _distance_sql(table: str, col: str) -> str:
    return f"""
      SELECT '{col}' AS name, round(max(abs(f - {phi_sql("z")})), 6) AS distance
      FROM (SELECT cume_dist() OVER (ORDER BY x) AS f, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z
            FROM (SELECT CAST({col} AS DOUBLE) AS x FROM {table}))"""


@query("i1_normal_distance", _distance_sql("lineitem", "l_extendedprice") + " UNION ALL " + _distance_sql("lineitem", "l_quantity"))
def i1_normal_distance(spark: SparkSession, sf: str) -> DataFrame:
    out = S.normal_distance(I.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return out.select("name", F.round("distance", 6).alias("distance"))


def _search_sql(table: str, col: str) -> str:
    return f"""
      WITH x AS (SELECT CAST({col} AS DOUBLE) AS x, cume_dist() OVER (ORDER BY {col}) AS f FROM {table}),
      y AS (SELECT k, f, sign(x) * asinh(pow(2.0::DOUBLE, k) * abs(x)) AS y FROM x, (SELECT unnest(range(-25, 26)) AS k)),
      m AS (SELECT k, avg(y) AS mu, stddev_samp(y) AS sd FROM y GROUP BY k),
      d AS (SELECT k, round(max(abs(f - {phi_sql("((y - mu) / sd)")})), 6) AS distance FROM y JOIN m USING (k) GROUP BY k)
      SELECT '{col}' AS name, CAST(k AS INTEGER) AS exponent, distance FROM d ORDER BY distance, k LIMIT 1"""


@query("i2_scale_search_orders", _search_sql("orders", "o_totalprice"))
def i2_scale_search_orders(spark: SparkSession, sf: str) -> DataFrame:
    return S.asinh_scale_search(I.table(spark, sf, "orders"), ["o_totalprice"])


@query("i2_scale_search_customer", _search_sql("customer", "c_acctbal"))
def i2_scale_search_customer(spark: SparkSession, sf: str) -> DataFrame:
    return S.asinh_scale_search(I.table(spark, sf, "customer"), ["c_acctbal"])


@query(
    "i2_asinh_scale",
    """SELECT c_nationkey, count(*) AS n, round(avg(sign(c_acctbal) * asinh(0.0009765625::DOUBLE * abs(c_acctbal))), 6) AS scaled
       FROM customer GROUP BY 1""",
)
def i2_asinh_scale(spark: SparkSession, sf: str) -> DataFrame:
    scaled = S.asinh_scale(I.table(spark, sf, "customer"), {"c_acctbal": 2.0**-10})
    return scaled.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("scaled"))


_LAZ_SQL = f"""
sm AS ({I.SUPPLIER_MONTHS_SQL}),
run AS (SELECT *, sum(quantity) OVER (PARTITION BY suppkey ORDER BY month ROWS UNBOUNDED PRECEDING) AS cum FROM sm),
laz AS (SELECT suppkey, max(CASE WHEN quantity IS NOT NULL AND cum = 0 THEN month END) AS quantity FROM run GROUP BY 1)"""


@query("i3_last_all_zero", f"WITH {_LAZ_SQL} SELECT suppkey, quantity FROM laz")
def i3_last_all_zero(spark: SparkSession, sf: str) -> DataFrame:
    return S.last_all_zero(I.supplier_months(spark, sf), "suppkey", "month", ["quantity"])


@query(
    "i4_zero_priors",
    f"""WITH {_LAZ_SQL} SELECT row_id, 'quantity' AS name, 0.0::DOUBLE AS mu, round((SELECT stddev_samp(quantity) FROM sm), 6) AS sigma
        FROM sm JOIN laz USING (suppkey) WHERE sm.quantity IS NULL AND month < laz.quantity""",
)
def i4_zero_priors(spark: SparkSession, sf: str) -> DataFrame:
    months = I.supplier_months(spark, sf)
    laz = S.last_all_zero(months, "suppkey", "month", ["quantity"])
    priors = S.zero_priors(months, laz, "row_id", "suppkey", "month", ["quantity"])
    return priors.withColumn("sigma", F.round("sigma", 6))


def masked_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-year totals with about a tenth of the cells hidden, on a log scale, plus a kind and a grade."""
    row = F.concat_ws("_", "suppkey", "year")
    panel = I.supplier_years(spark, sf).withColumn("row_id", row)
    hidden = {c: mask_draw(c, 10, F.col("row_id")) for c in ("total", "quantity", "lines", "kind")}
    return panel.select(
        "row_id",
        "suppkey",
        "year",
        F.when(~hidden["total"], F.ln("total")).alias("total"),
        F.when(~hidden["quantity"], F.sqrt("quantity")).alias("quantity"),
        F.when(~hidden["lines"], F.col("lines").cast("int")).alias("lines"),
        F.when(~hidden["kind"], F.when(F.col("quantity") > F.col("lines") * 25, "heavy").otherwise("light")).alias("kind"),
    )


@query(
    "i5_em_impute",
    f"""SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS imp, (SELECT count(*) FROM ({I.SUPPLIER_YEARS_SQL})) AS n,
               0::BIGINT AS nulls_left, 0::BIGINT AS changed, 0::BIGINT AS out_of_bounds""",
)
def i5_em_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Invariants of five imputations: complete, observed cells untouched, bounds kept."""
    masked = masked_panel(spark, sf)
    cols = ["total", "quantity", "lines", "kind"]
    done = em_impute(
        masked, "row_id", "year", "suppkey", noms=["kind"], ords=["lines"], bounds={"total": (0, None), "quantity": (0, None)}, m=5
    )
    before = masked.select("row_id", *[F.col(c).alias(f"was_{c}") for c in cols])
    both = done.join(before, "row_id")
    holes = sum((F.col(c).isNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNull().cast("int"))
    changed = F.lit(0)
    for c in cols:
        changed = changed + F.coalesce((F.col(f"was_{c}") != F.col(c)).cast("int"), F.lit(0))
    outside = (F.col("total") < 0) | (F.col("quantity") < 0)
    return both.groupBy("imp").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(holes).alias("nulls_left"),
        F.sum(changed).alias("changed"),
        F.count(F.when(outside, 1)).alias("out_of_bounds"),
    )


@query(
    "i5_imputation_accuracy",
    f"""WITH sy AS (SELECT suppkey || '_' || year AS row_id, * FROM ({I.SUPPLIER_YEARS_SQL}))
        SELECT 'total' AS name, count(*) AS n_hidden, 1 AS better_than_mean FROM sy WHERE {I.draw_sql("total", "row_id")} % 100 < 10
        UNION ALL SELECT 'quantity', count(*), 1 FROM sy WHERE {I.draw_sql("quantity", "row_id")} % 100 < 10""",
)
def i5_imputation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden cells are known here: the mean of five draws must be closer than the column mean."""
    masked = masked_panel(spark, sf)
    done = em_impute(
        masked, "row_id", "year", "suppkey", noms=["kind"], ords=["lines"], bounds={"total": (0, None), "quantity": (0, None)}, m=5
    )
    panel = I.supplier_years(spark, sf)
    truth = panel.select(
        F.concat_ws("_", "suppkey", "year").alias("row_id"), F.ln("total").alias("t_total"), F.sqrt("quantity").alias("t_quantity")
    )
    means = done.groupBy("row_id").agg(F.avg("total").alias("total"), F.avg("quantity").alias("quantity"))
    cells = [
        F.struct(F.lit(c).alias("name"), F.col(c).alias("drawn"), F.col(f"t_{c}").alias("known"), mask_draw(c, 10, F.col("row_id")).alias("hidden"))
        for c in ("total", "quantity")
    ]
    long = means.join(truth, "row_id").select(F.inline(F.array(*cells)))
    error = F.sqrt(F.avg(F.when(F.col("hidden"), F.pow(F.col("drawn") - F.col("known"), 2))))
    return long.groupBy("name").agg(
        F.count(F.when(F.col("hidden"), 1)).alias("n_hidden"), (error < F.stddev_samp("known")).cast("int").alias("better_than_mean")
    )


@query(
    "i5_unit_trends",
    f"""SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS imp, count(*) AS n, count(DISTINCT suppkey) AS units, 0::BIGINT AS nulls_left, 0::BIGINT AS changed,
               0::BIGINT AS out_of_bounds FROM ({I.SUPPLIER_YEARS_SQL})""",
)
def i5_unit_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Five imputations with a cubic trend of every supplier: complete, observed cells untouched, bounds kept."""
    masked = masked_panel(spark, sf)
    done = em_impute(
        masked, "row_id", "year", "suppkey", noms=["kind"], ords=["lines"], bounds={"total": (0, None), "quantity": (0, None)},
        polytime=3, intercs=True, m=5,
    )
    cols = ["total", "quantity", "lines", "kind"]
    both = done.join(masked.select("row_id", *[F.col(c).alias(f"was_{c}") for c in cols]), "row_id")
    holes, changed = F.lit(0), F.lit(0)
    for c in cols:
        holes = holes + F.col(c).isNull().cast("int")
        changed = changed + F.coalesce((F.col(f"was_{c}") != F.col(c)).cast("int"), F.lit(0))
    return both.groupBy("imp").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("suppkey").alias("units"),
        F.sum(holes).alias("nulls_left"),
        F.sum(changed).alias("changed"),
        F.count(F.when((F.col("total") < 0) | (F.col("quantity") < 0), 1)).alias("out_of_bounds"),
    )
