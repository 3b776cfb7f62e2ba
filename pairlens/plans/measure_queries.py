"""The long paths on the market pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import mask_draw
from ..operators import features as X
from ..operators.pairs import PAIR, event_flags, make_pairs, mirror_pairs
from ..operators.spells import lag_features, time_since
from ..session import materialize
from . import inputs as I
from .catalog import query
from .measure import directed_replicates, risk_measure
from .pair_queries import PAIR_FRAME_SQL, _PAIR_EVENTS, pair_frame


@query(
    "directed_replicates",
    f"""WITH {I.MARKETS_SQL} SELECT CAST(i AS INTEGER) AS imp_i, CAST(j AS INTEGER) AS imp_j, 2 * (SELECT count(*) FROM pairs) AS n,
               (SELECT count(*) FROM pairs) AS forward, 0::BIGINT AS nulls_left, 0::BIGINT AS unmatched
        FROM (SELECT unnest([1, 2, 3, 4, 5]) AS i), (SELECT unnest([1, 2, 3, 4, 5]) AS j)""",
)
def directed_replicates_query(spark: SparkSession, sf: str) -> DataFrame:
    """Five by five replicates of the directed pairs: complete, and each row has its mirror image."""
    panel = I.stored_market_years(spark, sf)
    key = F.concat_ws("_", "unit", "year")
    masked = panel.select(
        "unit",
        "year",
        F.when(~mask_draw("total", 10, key), F.ln("total")).alias("total"),
        F.when(~mask_draw("quantity", 10, key), F.sqrt("quantity")).alias("quantity"),
    )
    pairs = make_pairs(panel, "unit", "year")
    flags = event_flags(pairs, I.events(spark, sf), "year", {"ud_ongoing": 0, "ud_recent": 10}, I.YEARS)
    flags = time_since(flags, list(PAIR), "year", "ud_ongoing", "ud_quiet")
    pair_key = F.concat_ws("_", *PAIR, "year")
    flags = flags.withColumn("ud_quiet", F.when(~mask_draw("quiet", 10, pair_key), F.col("ud_quiet").cast("double")))
    path = directed_replicates(
        masked, "unit", "year", ["total", "quantity"], flags,
        {"bounds": {"total": (0, None), "quantity": (0, None)}},
        {"bounds": {"ud_quiet": (0, None)}, "noms": ["ud_ongoing", "ud_recent", "A_attacked", "B_attacked"]},
        m_panel=5, m_pairs=5,
    )
    stored = spark.read.parquet(path)
    holes = sum((F.col(c).isNull().cast("int") for c in ("A_total", "B_total", "A_quantity", "B_quantity")), F.col("ud_quiet").isNull().cast("int"))
    # A row and its mirror cancel in these differences.
    sides = F.round(F.sum(F.col("A_total") - F.col("B_total")), 6)
    return stored.groupBy("imp_i", "imp_j").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("a_unit") < F.col("b_unit"), 1)).alias("forward"),
        F.sum(holes).cast("bigint").alias("nulls_left"),
        F.abs(sides).cast("bigint").alias("unmatched"),
    )


RISK_FEATURES = ("A_total", "B_total", "A_quantity", "B_quantity", "ud_quiet_lag", "ud_recent_lag")


@query(
    "risk_measure",
    f"""{_PAIR_EVENTS}, {PAIR_FRAME_SQL},
        d AS (SELECT a_unit AS a, b_unit AS b, year FROM pair_frame UNION ALL SELECT b_unit, a_unit, year FROM pair_frame),
        l AS (SELECT *, lag(year) OVER (PARTITION BY a, b ORDER BY year) AS before FROM d)
        SELECT a AS unit, year, count(*) AS n_pairs, 1 AS in_range FROM l WHERE before IS NOT NULL GROUP BY 1, 2""",
)
def risk_measure_query(spark: SparkSession, sf: str) -> DataFrame:
    """Probability that a market is the target of at least one onset in a year, by the fitted ensemble."""
    directed = mirror_pairs(pair_frame(spark, sf).drop("ud_ongoing"))
    directed = lag_features(directed, list(PAIR), "year", ["ud_quiet", "ud_recent"])
    rows = X.derive_features(
        directed.na.drop(subset=["ud_quiet_lag"]), logs=["A_total", "B_total"], lead=[*PAIR, "year"]
    )
    rows = materialize(rows.withColumn("row_id", F.concat_ws("_", *PAIR, "year")), "directed", rebalance=True)
    frame = X.model_frame(rows, "row_id", F.col("B_attacked"), RISK_FEATURES)
    units = rows.select("row_id", F.col("a_unit").alias("unit"), "year")
    risk, _, _ = risk_measure(frame, units)
    return risk.select("unit", "year", "n_pairs", F.col("risk").between(0, 1).cast("int").alias("in_range"))
