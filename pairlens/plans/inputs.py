"""The driver's tables read as panels, spells, events and pairs.

Units of the pair plans are markets: supplier nation by part type.  Their number is
fixed by the two dimensions (25 x 6), so all pairs of a period stay a bounded table at
any data size, while the facts behind them grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import mask_draw
from ..operators.codes import group_filter
from ..operators.pairs import event_pairs, make_pairs
from ..session import materialize

YEARS = (1995, 2001)
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def money(col: Column | str) -> Column:
    """Sums of two-digit amounts, exact in any engine."""
    return F.round(F.sum(col), 2)


def year_of(col: str) -> Column:
    return F.year(col)


def month_index(col: str) -> Column:
    """Months since year zero, so that spans of months are integer ranges."""
    return F.year(col) * 12 + F.month(col) - 1


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def supplier_years(spark: SparkSession, sf: str) -> DataFrame:
    """``suppkey, year, total, quantity, lines``: a panel keyed by (suppkey, year)."""
    return (
        order_lines(spark, sf)
        .groupBy(F.col("l_suppkey").alias("suppkey"), year_of("o_orderdate").alias("year"))
        .agg(money("l_extendedprice").alias("total"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    )


SUPPLIER_YEARS_SQL = """
  SELECT l_suppkey AS suppkey, CAST(year(o_orderdate) AS INTEGER) AS year,
         round(sum(l_extendedprice), 2) AS total, sum(l_quantity) AS quantity, count(*) AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def nation_years(spark: SparkSession, sf: str) -> DataFrame:
    """``nation, year, total, n_orders`` of the customers' nations."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("nation"), year_of("o_orderdate").alias("year")).agg(
        money("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders")
    )


NATION_YEARS_SQL = """
  SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year,
         round(sum(o_totalprice), 2) AS total, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


def type_code() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("p_type")).cast("int")


TYPE_CODE_SQL = "CASE p_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES, 1)) + " END"


def with_market(lines: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Add the market code of every line."""
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf, "part").select("p_partkey", type_code().alias("type_code"))
    out = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return out.withColumn("unit", F.col("s_nationkey") * 10 + F.col("type_code"))


def market_years(spark: SparkSession, sf: str) -> DataFrame:
    """``unit, year, total, quantity``: the market panel."""
    return (
        with_market(order_lines(spark, sf), spark, sf)
        .groupBy("unit", year_of("o_orderdate").alias("year"))
        .agg(money("l_extendedprice").alias("total"), F.sum("l_quantity").alias("quantity"))
    )


def stored_market_years(spark: SparkSession, sf: str) -> DataFrame:
    """The market panel written once, for plans that read it several times."""
    return materialize(market_years(spark, sf), "market-years")


MARKET_LINES_SQL = f"""
  SELECT s_nationkey * 10 + {TYPE_CODE_SQL} AS unit, CAST(year(o_orderdate) AS INTEGER) AS year, lineitem.*, orders.*
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""

MARKETS_SQL = f"""
market_lines AS ({MARKET_LINES_SQL}),
market_years AS (
  SELECT unit, year, round(sum(l_extendedprice), 2) AS total, sum(l_quantity) AS quantity
  FROM market_lines GROUP BY 1, 2),
pairs AS (
  SELECT a.unit AS a_unit, b.unit AS b_unit, a.year AS year
  FROM market_years a JOIN market_years b ON a.year = b.year AND a.unit < b.unit)"""


def participants(spark: SparkSession, sf: str) -> DataFrame:
    """Market participants of the events: all orders with at least one large line."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = group_filter(lines, "l_orderkey", any_=F.col("l_quantity") >= 45)
    start = year_of("o_orderdate")
    return with_market(lines, spark, sf).select(
        F.col("l_orderkey").alias("event"),
        "unit",
        (F.col("l_linestatus") == "O").cast("int").alias("side"),
        start.alias("start"),
        F.greatest(start, year_of("l_shipdate")).alias("end"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return event_pairs(participants(spark, sf), "event", "side", "unit", "start", "end")


EVENTS_SQL = """
joined AS (
  SELECT o_orderkey AS event, unit, l_linestatus AS side, year AS s,
         greatest(year, CAST(year(l_shipdate) AS INTEGER)) AS e
  FROM market_lines
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)),
span AS (SELECT event, min(s) AS "start", max(e) AS "end" FROM joined GROUP BY event),
events AS (
  SELECT DISTINCT a.event, a.unit AS attacker, b.unit AS target, span."start", span."end"
  FROM joined a JOIN joined b ON a.event = b.event JOIN span ON span.event = a.event
  WHERE a.side = 'O' AND b.side = 'F' AND a.unit <> b.unit)"""


def market_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return make_pairs(market_years(spark, sf), "unit", "year")


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """``user_id, day, n, value, kill``: a panel with gaps; kill marks a day with an error."""
    return (
        table(spark, sf, "events")
        .groupBy("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            money("value").alias("value"),
            F.max((F.col("event_type") == "error").cast("int")).alias("kill"),
        )
    )


USER_DAYS_SQL = """
  SELECT user_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, count(*) AS n,
         round(sum(value), 2) AS value, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS kill
  FROM events GROUP BY 1, 2"""


def supplier_months(spark: SparkSession, sf: str) -> DataFrame:
    """``suppkey, month, quantity``: returned quantity per ship month, 0 if none, NULL where masked."""
    lines = table(spark, sf, "lineitem")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    months = lines.groupBy(F.col("l_suppkey").alias("suppkey"), month_index("l_shipdate").alias("month")).agg(
        F.sum(returned).alias("quantity")
    )
    row = F.concat_ws("_", "suppkey", "month")
    return months.select(
        row.alias("row_id"), "suppkey", "month", F.when(~mask_draw(11, 10, row), F.col("quantity")).alias("quantity")
    )


SUPPLIER_MONTHS_SQL = """
  SELECT row_id, suppkey, month, CASE WHEN ('0x' || substr(md5('11:' || row_id), 1, 15))::BIGINT % 100 >= 10 THEN q END AS quantity
  FROM (SELECT l_suppkey || '_' || month AS row_id, l_suppkey AS suppkey, month, q FROM (
    SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month,
           sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS q
    FROM lineitem GROUP BY 1, 2))"""


def draw_sql(seed: int | str, expr: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {expr}), 1, 15))::BIGINT"


DOC_MODELS = {"steep": 1.0, "flat": 0.5, "inverse": -0.25}


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return table(spark, sf, "labels").select("doc_id", "toxic").join(docs, "doc_id")


def fixed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, label, model, p``: logistic functions of the document length, one per model."""
    rows = labelled(spark, sf)
    # One row, so a scalar subquery; its fields share one execution.
    fit = rows.agg(
        F.struct(
            F.avg("n_chars").alias("mean"),
            F.stddev_samp("n_chars").alias("sd"),
            F.avg(F.col("toxic").cast("double")).alias("base"),
        )
    ).scalar()
    z, base = (F.col("n_chars") - fit["mean"]) / fit["sd"], fit["base"]
    cells = [
        F.struct(F.lit(m).alias("model"), F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(k) * z)), 9).alias("p"))
        for m, k in DOC_MODELS.items()
    ]
    cells.append(F.struct(F.lit("null").alias("model"), F.round(base, 9).alias("p")))
    return rows.select(F.col("doc_id").alias("row_id"), F.col("toxic").cast("double").alias("label"), F.inline(F.array(*cells)))


PREDICTIONS_SQL = """
docs AS (SELECT doc_id, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
fit AS (SELECT avg(n_chars) AS mu, stddev_samp(n_chars) AS sd, avg(toxic) AS base FROM docs),
preds AS (
  SELECT doc_id AS row_id, CAST(toxic AS DOUBLE) AS label, model,
         round(CASE WHEN model = 'null' THEN base ELSE 1.0::DOUBLE / (1 + exp(-k * (n_chars - mu) / sd)) END, 9) AS p
  FROM docs, fit, (VALUES ('steep', 1.0::DOUBLE), ('flat', 0.5::DOUBLE), ('inverse', -0.25::DOUBLE), ('null', 0::DOUBLE)) m(model, k))"""
