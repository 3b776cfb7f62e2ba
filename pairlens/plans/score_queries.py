"""Scores, ensemble and the final unit-level measure on fixed predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import scoring as R
from ..operators.pairs import mirror_pairs
from ..session import materialize
from . import inputs as I
from .catalog import query
from .pair_queries import PAIR_FRAME_SQL, _PAIR_EVENTS, pair_frame

_P = f"WITH {I.PREDICTIONS_SQL}"
_LL = "avg(-(label * ln(p + 2.220446049250313e-16) + (1 - label) * ln(1 - p + 2.220446049250313e-16)))"
_CELLS = """count(CASE WHEN p >= 0.5 AND label = 1 THEN 1 END) AS tp, count(CASE WHEN p < 0.5 AND label = 0 THEN 1 END) AS tn,
            count(CASE WHEN p >= 0.5 AND label = 0 THEN 1 END) AS fp, count(CASE WHEN p < 0.5 AND label = 1 THEN 1 END) AS fn"""
_RATES = """round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity,
            round(tn / nullif(tn + fn, 0), 6) AS npv, round(tp / nullif(tp + fp, 0), 6) AS precision,
            round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
            round(((tp + tn) / (tp + tn + fp + fn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn)))
                  / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn))), 6) AS kappa"""
# Share of (positive, negative) pairs in the right order, ties counted half: the definition, not the rank formula.
_AUC = """SELECT a.model, round(avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END), 6) AS auc
          FROM preds a JOIN preds b ON a.model = b.model AND a.label = 1 AND b.label = 0 GROUP BY 1"""

RATES = ("sensitivity", "specificity", "npv", "precision", "accuracy", "kappa")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.simpleString() == "double"})


@query("r1_log_loss", f"{_P} SELECT model, round({_LL}, 6) AS log_loss FROM preds GROUP BY 1")
def r1_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.log_loss(I.fixed_predictions(spark, sf), "label", "p", ["model"]))


# A weight from the row's id: what a down-sampled fit would count the row as.
_WEIGHTED = "wp AS (SELECT *, 1.0::DOUBLE + row_id % 4 AS weight FROM preds)"


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return I.fixed_predictions(spark, sf).withColumn("weight", F.lit(1.0) + F.col("row_id") % 4)


@query(
    "r1_log_loss_weighted",
    f"""{_P}, {_WEIGHTED} SELECT model, round(sum(-weight * (label * ln(p + 2.220446049250313e-16)
          + (1 - label) * ln(1 - p + 2.220446049250313e-16))) / sum(weight), 6) AS log_loss FROM wp GROUP BY 1""",
)
def r1_log_loss_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.log_loss(_weighted(spark, sf), "label", "p", ["model"], weight="weight"))


@query(
    "r3_auc_weighted",
    f"""{_P}, {_WEIGHTED} SELECT a.model, round(sum(a.weight * b.weight * CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END)
          / sum(a.weight * b.weight), 6) AS auc FROM wp a JOIN wp b ON a.model = b.model AND a.label = 1 AND b.label = 0 GROUP BY 1""",
)
def r3_auc_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.auc(_weighted(spark, sf), "label", "p", ["model"], weight="weight"))


@query("r2_confusion", f"{_P}, c AS (SELECT model, {_CELLS} FROM preds GROUP BY 1) SELECT *, {_RATES} FROM c")
def r2_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.confusion(I.fixed_predictions(spark, sf), "label", "p", ["model"]).drop("log_loss"))


@query("r3_auc", f"{_P} {_AUC}")
def r3_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.auc(materialize(I.fixed_predictions(spark, sf), "predictions"), "label", "p", ["model"]))


@query(
    "r3_auc_orders",
    """WITH t AS (SELECT CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y, floor(o_totalprice / 1000) AS p FROM orders),
            r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS mid FROM t)
       SELECT round((sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)::DOUBLE), 6) AS auc FROM r""",
)
def r3_auc_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "orders").select(
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), F.floor(F.col("o_totalprice") / 1000).alias("p")
    )
    return _rounded(R.auc(rows, "y", "p"))


@query(
    "r4_score_models",
    f"""{_P}, c AS (SELECT model, {_CELLS}, round({_LL}, 6) AS log_loss FROM preds GROUP BY 1), a AS ({_AUC})
        SELECT c.*, {_RATES}, auc FROM c JOIN a USING (model)""",
)
def r4_score_models(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.score_models(materialize(I.fixed_predictions(spark, sf), "predictions")))


@query(
    "r5_prediction_matrix",
    f"""{_P} SELECT row_id, max(CASE WHEN model = 'steep' THEN p END) AS steep, max(CASE WHEN model = 'flat' THEN p END) AS flat,
             max(CASE WHEN model = 'inverse' THEN p END) AS inverse FROM preds GROUP BY 1""",
)
def r5_prediction_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return R.prediction_matrix(I.fixed_predictions(spark, sf), list(I.DOC_MODELS))


WEIGHTS = {"steep": 0.5, "flat": 0.3, "null": 0.2}


@query(
    "r7_blend",
    f"""{_P} SELECT row_id, label, 'ensemble' AS model,
             round(sum(p * CASE model WHEN 'steep' THEN 0.5::DOUBLE WHEN 'flat' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END), 10) AS p
             FROM preds WHERE model <> 'inverse' GROUP BY 1, 2""",
)
def r7_blend(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.blend(I.fixed_predictions(spark, sf), WEIGHTS, "row_id", ["label"]), 10)


@query(
    "r9_proportional_reduction",
    f"""{_P}, s AS (SELECT model, {_LL} AS ll FROM preds GROUP BY 1)
        SELECT model, round(ll, 6) AS log_loss, round(abs((ll - (SELECT ll FROM s WHERE model = 'null')) / (SELECT ll FROM s WHERE model = 'null')), 6) AS reduction FROM s""",
)
def r9_proportional_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.proportional_reduction(R.log_loss(I.fixed_predictions(spark, sf), "label", "p", ["model"])))


@query(
    "r10_leaderboard",
    f"""{_P}, s AS (SELECT model, {_LL} AS ll FROM preds GROUP BY 1)
        SELECT CASE model WHEN 'null' THEN 'Null' WHEN 'steep' THEN 'Steep Logit' WHEN 'flat' THEN 'Flat Logit' ELSE model END AS model,
               round(ll, 3) AS log_loss, 1.5::DOUBLE AS minutes FROM s ORDER BY ll""",
)
def r10_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    scores = R.log_loss(I.fixed_predictions(spark, sf), "label", "p", ["model"]).withColumn("seconds", F.lit(90.0))
    labels = spark.createDataFrame(
        [("null", "Null"), ("steep", "Steep Logit"), ("flat", "Flat Logit")], "model string, label string"
    )
    return R.leaderboard(scores, labels)


_RISK_P = "1.0::DOUBLE / (1 + exp(6 + ud_quiet / 2.0::DOUBLE - 2 * ud_recent - imp / 10.0::DOUBLE))"


@query(
    "r11_unit_risk",
    f"""{_PAIR_EVENTS}, {PAIR_FRAME_SQL},
        d AS (SELECT b_unit AS unit, year, ud_quiet, ud_recent FROM pair_frame UNION ALL SELECT a_unit, year, ud_quiet, ud_recent FROM pair_frame),
        s AS (SELECT unit, year, imp, 1 - exp(sum(ln(1 - {_RISK_P}))) AS risk, count(*) AS n
              FROM d, (SELECT unnest(range(1, 4)) AS imp) GROUP BY ALL)
        SELECT unit, year, round(avg(risk), 6) AS risk, max(n) AS n_pairs FROM s GROUP BY 1, 2""",
)
def r11_unit_risk(spark: SparkSession, sf: str) -> DataFrame:
    directed = mirror_pairs(pair_frame(spark, sf).select("a_unit", "b_unit", "year", "ud_quiet", "ud_recent"))
    reps = directed.withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(3))))
    z = F.lit(6.0) + F.col("ud_quiet") / 2.0 - F.col("ud_recent") * 2 - F.col("imp") / 10.0
    preds = reps.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(z)))
    risk = R.unit_risk(preds, "b_unit", "year", replicate="imp")
    return _rounded(risk.withColumnRenamed("b_unit", "unit"))
