"""Model frame, sampling, fits and validation on the driver's tables.

The outcome is the rare label ``toxic`` of the documents.  Fitted numbers depend on the
optimiser, so the twins of the fits state what must hold whatever it does: every row is
scored once, probabilities lie in [0, 1], and so on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import exact_quantiles
from ..operators import features as X
from ..operators import models as M
from ..operators import sampling as G
from ..operators import validation as V
from ..operators.adaboost import fit_stumps, stump_scorer, training_bound
from ..operators.densities import kernel_grids
from ..operators.ensemble import ablate, ensemble_weights
from ..operators.imputation import em_impute
from ..operators.pairs import PAIR, mirror_pairs
from ..operators.scoring import blend, score_models
from ..operators.spells import lag_features
from ..operators.splines import search_splines
from ..session import materialize
from . import inputs as I
from .catalog import query
from .pair_queries import PAIR_FRAME_SQL, _PAIR_EVENTS, pair_frame
from .scaling_queries import masked_panel

LANGS = ("en", "de", "es", "fr")
FEATURES = ("len", "words", "lines", "digits", "upper", "lang_de", "lang_es", "lang_fr")


def document_features(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, toxic`` and features of the whole text of every document; ``toxic`` is NULL where it is unknown."""
    docs = I.table(spark, sf, "documents").withColumn("found", X.character_counts("text"))
    size = F.greatest(F.length("text"), F.lit(1))
    # Texts become numbers before rows are joined, so that they are not shuffled.
    docs = docs.select(
        "doc_id",
        "lang",
        F.ln(F.col("n_chars") + 1).alias("len"),
        (F.col("found.blanks") / size).alias("words"),
        F.ln(F.col("found.breaks") + 1).alias("lines"),
        (F.col("found.digits") / size).alias("digits"),
        (F.col("found.capitals") / size).alias("upper"),
    )
    rows = docs.join(I.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return X.dummy_encode(rows, "lang", LANGS)


def everything(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, label, features`` of every document, written once because every fit reads it many times."""
    return materialize(X.model_frame(document_features(spark, sf), "doc_id", F.col("toxic"), FEATURES), "model-frame", rebalance=True)


def frame(spark: SparkSession, sf: str, folds: int = 0) -> DataFrame:
    """``row_id, label, features[, fold]`` of the labelled documents; the texts are read before rows are ranked."""
    rows = everything(spark, sf).where("label IS NOT NULL")
    if folds:
        rows = materialize(G.assign_folds(rows, folds, 90210, "label", "row_id"), "model-folds", rebalance=True)
    return rows


# --- features and sampling -------------------------------------------------------------------


@query(
    "m1_derive_features",
    f"""{_PAIR_EVENTS}, {PAIR_FRAME_SQL},
        d AS (SELECT a_unit, b_unit, year, A_attacked, B_attacked, A_total, B_total, A_quantity, B_quantity, ud_quiet, ud_recent FROM pair_frame UNION ALL
              SELECT b_unit, a_unit, year, B_attacked, A_attacked, B_total, A_total, B_quantity, A_quantity, ud_quiet, ud_recent FROM pair_frame),
        l AS (SELECT *, ud_quiet * ud_quiet / 100.0::DOUBLE AS q2, CAST(ud_quiet AS DOUBLE) ** 3 / 1000.0::DOUBLE AS q3,
                     lag(ud_quiet) OVER (PARTITION BY a_unit, b_unit ORDER BY year) AS ud_quiet_lag,
                     lag(ud_recent) OVER (PARTITION BY a_unit, b_unit ORDER BY year) AS ud_recent_lag FROM d)
        SELECT a_unit, b_unit, year, CASE WHEN B_attacked = 1 THEN 'yes' ELSE 'no' END AS B_attacked, A_quantity, B_quantity,
               round(ln(A_total), 6) AS A_total, round(ln(B_total), 6) AS B_total,
               CAST(A_quantity >= 1500 AND B_quantity >= 1500 AS INTEGER) AS ud_both, ud_quiet, round(q2, 6) AS ud_quiet2,
               round(q3, 6) AS ud_quiet3, ud_quiet_lag, ud_recent_lag
        FROM l WHERE year > 1995""",
)
def m1_derive_features(spark: SparkSession, sf: str) -> DataFrame:
    directed = mirror_pairs(pair_frame(spark, sf).drop("ud_ongoing"))
    directed = lag_features(directed, list(PAIR), "year", ["ud_quiet", "ud_recent"])
    out = X.derive_features(
        directed,
        joint={"ud_both": ("A_quantity", "B_quantity", 1500)},
        logs=["A_total", "B_total"],
        powers={"ud_quiet": [(2, 100), (3, 1000)]},
        target="B_attacked",
        drop=["A_attacked", "ud_recent"],
        lead=[*PAIR, "year"],
        where=F.col("year") > I.YEARS[0],
    )
    return out.withColumns({c: F.round(c, 6) for c in ("A_total", "B_total", "ud_quiet2", "ud_quiet3")})


@query(
    "m2_dummy_encode",
    """SELECT o_orderkey, CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "o_orderpriority_2-HIGH",
              CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS "o_orderpriority_1-URGENT"
       FROM (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('5-LOW', '2-HIGH', '1-URGENT') THEN o_orderpriority END AS o_orderpriority FROM orders)""",
)
def m2_dummy_encode(spark: SparkSession, sf: str) -> DataFrame:
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return X.dummy_encode(orders, "o_orderpriority", ["5-LOW", "2-HIGH", "1-URGENT"])


def _split_sql(table: str, key: str, target: str) -> str:
    return f"""
      WITH a AS (SELECT {key} AS id, {target} AS cls FROM {table}),
      b AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('90210:' || id), id)
                      <= ceil(0.6::DOUBLE * count(*) OVER (PARTITION BY cls)) AS train FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('555:' || id), id)
                      <= ceil((1.0::DOUBLE / 3) * count(*) OVER (PARTITION BY cls)) AS ev FROM b WHERE NOT train)
      SELECT b.id, b.cls, CASE WHEN b.train THEN 'train' WHEN c.ev THEN 'eval' ELSE 'test' END AS part FROM b LEFT JOIN c ON c.id = b.id"""


@query("m3_stratified_split", _split_sql("labels", "doc_id", "toxic"))
def m3_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("cls"))
    return G.train_eval_test(rows, "cls", "id")


@query("m3_stratified_split_orders", _split_sql("orders", "o_orderkey", "o_orderpriority"))
def m3_stratified_split_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("cls"))
    return G.train_eval_test(rows, "cls", "id")


@query(
    "m4_resample",
    f"""WITH s AS (SELECT toxic, count(*) AS size, row_number() OVER () FROM labels GROUP BY toxic),
        n AS (SELECT size AS n1 FROM s WHERE toxic = 1),
        r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) AS rnk FROM labels),
        d AS (SELECT 1 AS toxic, unnest(range(0, (SELECT n1 FROM n))) AS i UNION ALL
              SELECT 0, unnest(range(0, 100 * (SELECT n1 FROM n)))),
        x AS (SELECT d.toxic, {I.draw_sql(42, "d.toxic || ':' || i")} % size + 1 AS rnk FROM d JOIN s ON s.toxic = d.toxic)
        SELECT doc_id, toxic, count(*) AS n FROM x JOIN r USING (toxic, rnk) GROUP BY ALL""",
)
def m4_resample(spark: SparkSession, sf: str) -> DataFrame:
    labels = I.table(spark, sf, "labels").select("doc_id", "toxic")
    drawn = G.resample(labels, "toxic", 42, "doc_id", ratio=100)
    return drawn.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("n"))


def _inside(col: str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.count(F.when((F.col(col) < low) | (F.col(col) > high) | F.col(col).isNull(), 1))


@query(
    "m5_downsample_curve",
    """SELECT r AS ratio, 100::BIGINT AS n_reps, 0::BIGINT AS bad_loss, 0::BIGINT AS bad_auc
       FROM (SELECT CAST(unnest([1, 2, 3, 4, 5, 10, 25, 50, 100, 250]) AS DOUBLE) AS r UNION ALL
             SELECT round(n0 / n1, 6) FROM (SELECT sum(c0)::DOUBLE AS n0, sum(c1)::DOUBLE AS n1 FROM (
               SELECT CASE WHEN toxic = 0 THEN k END AS c0, CASE WHEN toxic = 1 THEN k END AS c1
               FROM (SELECT toxic, ceil(0.6::DOUBLE * count(*)) AS k FROM labels GROUP BY toxic))))""",
)
def m5_downsample_curve(spark: SparkSession, sf: str) -> DataFrame:
    split = materialize(G.train_eval_test(frame(spark, sf), "label", "row_id"), "split", rebalance=True)
    curve = V.downsample_curve(
        split.where("part = 'train'"), split.where("part = 'eval'"), reps=100
    )
    return curve.groupBy(F.round("ratio", 6).alias("ratio")).agg(
        F.count(F.lit(1)).alias("n_reps"),
        _inside("log_loss", 0.0, 40.0).alias("bad_loss"),
        _inside("auc").alias("bad_auc"),
    )


@query(
    "m6_curve_summary",
    """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se,
              round(quantile_cont(o_totalprice, 0.05), 4) AS lower, round(quantile_cont(o_totalprice, 0.95), 4) AS upper
       FROM orders GROUP BY 1""",
)
def m6_curve_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = G.curve_summary(I.table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "se", "lower", "upper")})


@query(
    "m7_assign_folds",
    """SELECT doc_id, toxic, CAST(row_number() OVER (PARTITION BY toxic ORDER BY md5('7:' || doc_id), doc_id) % 10 AS INTEGER) AS fold
       FROM labels""",
)
def m7_assign_folds(spark: SparkSession, sf: str) -> DataFrame:
    return G.assign_folds(I.table(spark, sf, "labels").select("doc_id", "toxic"), 10, 7, "toxic", "doc_id")


# --- classifiers ---------------------------------------------------------------------------


@query(
    "k1_null",
    """SELECT doc_id AS row_id, CAST(toxic AS DOUBLE) AS label, 'null' AS model,
              round((SELECT avg(toxic) FROM labels JOIN documents USING (doc_id)), 9) AS p
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def k1_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = everything(spark, sf)
    return M.fit_predict(rows.where("label IS NOT NULL"), rows, "null").withColumn("p", F.round("p", 9))


_FIT_SQL = """SELECT '{name}' AS model, CAST(s AS INTEGER) AS setting, count(*) AS n, count(DISTINCT doc_id) AS n_scored, 0::BIGINT AS bad_p
              FROM documents, (SELECT unnest(range(1, {settings} + 1)) AS s) GROUP BY s"""


@query(
    "k2_logit",
    """SELECT 'logit' AS model, count(*) AS n, count(DISTINCT doc_id) AS n_scored, 0::BIGINT AS bad_p, round(avg(toxic), 3) AS mean_p
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def k2_logit(spark: SparkSession, sf: str) -> DataFrame:
    """The score equation makes the mean fitted probability equal to the base rate."""
    rows = everything(spark, sf)
    preds = M.fit_predict(rows.where("label IS NOT NULL"), rows, "logit")
    return preds.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("row_id").alias("n_scored"),
        _inside("p").alias("bad_p"),
        F.round(F.avg(F.when(F.col("label").isNotNull(), F.col("p"))), 3).alias("mean_p"),
    )


def _register_fit(key: str, family: str) -> None:
    grid = M.FAMILIES[family].grid

    @query(f"{key}_{family}", _FIT_SQL.format(name=family, settings=len(grid)))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = everything(spark, sf)
        known = rows.where("label IS NOT NULL")
        tried = [M.fit_predict(known, rows, family, s).withColumn("setting", F.lit(i)) for i, s in enumerate(grid, 1)]
        return reduce(DataFrame.unionByName, tried).groupBy("model", "setting").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_scored"), _inside("p").alias("bad_p")
        )

    run.__name__ = f"{key}_{family}"
    run.__doc__ = f"Fit every setting of {family} on the labelled documents, score all documents with each."


_register_fit("k3", "boosted_logit")
_register_fit("k5", "naive_bayes")
_register_fit("k6", "splines")
_register_fit("k7", "tree")
_register_fit("k8", "forest")
_register_fit("k9", "boosted_trees")
_register_fit("k10", "radial_svm")
_register_fit("k11", "averaged_nets")
_register_fit("k12", "perceptron")
_register_fit("k5", "kernel_bayes")
_register_fit("k6", "adaptive_splines")
_register_fit("k9", "discrete_boosting")


@query(
    "k5_kernel_densities",
    """WITH d AS (SELECT toxic, ln(n_chars + 1) AS v FROM labels JOIN documents USING (doc_id)),
       s AS (SELECT toxic, count(*)::DOUBLE AS n, stddev_samp(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, min(v) AS lo, max(v) AS hi FROM d GROUP BY 1),
       h AS (SELECT *, 0.9::DOUBLE * least(sd, iqr / 1.34::DOUBLE) * n ** (-0.2::DOUBLE) AS w FROM s),
       g AS (SELECT *, lo - 3 * w AS low, (hi + 3 * w - (lo - 3 * w)) / 63 AS step FROM h),
       p AS (SELECT toxic, (v - low) / step AS pos, least(floor((v - low) / step), 62) AS k FROM d JOIN g USING (toxic)),
       b AS (SELECT toxic, k, sum(c) AS c FROM (SELECT toxic, k, 1 - (pos - k) AS c FROM p UNION ALL SELECT toxic, k + 1, pos - k FROM p) GROUP BY 1, 2)
       SELECT toxic, i::INTEGER AS i, round(any_value(low + step * i), 6) AS x,
              round(sum(c * exp(-(((i - k) * step / w) ** 2) / 2)) / any_value(n * w) / sqrt(2 * pi()), 6) AS density
       FROM g JOIN b USING (toxic), (SELECT unnest(range(0, 64)) AS i) GROUP BY toxic, i""",
)
def k5_kernel_densities(spark: SparkSession, sf: str) -> DataFrame:
    """Densities of the length of documents, for both classes, on 64 points each."""
    rows = I.labelled(spark, sf).select("toxic", F.ln(F.col("n_chars") + 1).alias("value"))
    grids = kernel_grids(rows, ["toxic"], points=64)
    out = grids.select("toxic", "low", "step", F.posexplode("density").alias("i", "d"))
    return out.select("toxic", "i", F.round(F.col("low") + F.col("step") * F.col("i"), 6).alias("x"), F.round("d", 6).alias("density"))


@query(
    "k6_spline_search",
    """WITH k AS (SELECT quantile_cont(o_totalprice, [1.0 / 16, 2.0 / 16, 3.0 / 16, 4.0 / 16, 5.0 / 16, 6.0 / 16, 7.0 / 16, 8.0 / 16, 9.0 / 16, 10.0 / 16, 11.0 / 16,
              12.0 / 16, 13.0 / 16, 14.0 / 16, 15.0 / 16]) AS ks FROM orders),
            y AS (SELECT greatest(o_totalprice - ks[11], 0) - 2 * greatest(ks[4] - o_totalprice, 0) AS y FROM orders, k)
       SELECT 2::BIGINT AS n_hinges, round(max(ks[4]), 2) AS low_knot, round(max(ks[11]), 2) AS high_knot, 1 AS explained, round(sum((y - (SELECT avg(y) FROM y)) ** 2) / 1e12, 3) AS total
       FROM y, k""",
)
def k6_spline_search(spark: SparkSession, sf: str) -> DataFrame:
    """An outcome with two kinks in the price of orders: the search finds both, and only them."""
    orders = I.table(spark, sf, "orders").select(F.col("o_totalprice").cast("double").alias("price"))
    probs = {f"k{i}": i / 16 for i in range(1, 16)}
    knots = list(exact_quantiles(orders, "price", probs).select(*probs).first())
    kinked = F.greatest(F.col("price") - knots[10], F.lit(0.0)) - 2 * F.greatest(F.lit(knots[3]) - F.col("price"), F.lit(0.0))
    rows = orders.select(F.array("price").alias("features"), kinked.alias("label"))
    found = search_splines(rows, {0: knots})
    mean = rows.agg(F.avg("label")).first()[0]
    total = F.sum(F.pow(F.col("label") - F.lit(mean), 2))
    chosen = sorted(h.knot for h in found.hinges)
    return rows.agg(
        F.lit(len(found.hinges)).cast("long").alias("n_hinges"), F.round(F.lit(chosen[0]), 2).alias("low_knot"), F.round(F.lit(chosen[-1]), 2).alias("high_knot"),
        (F.lit(found.residual) < total * 1e-6).cast("int").alias("explained"), F.round(total / 1e12, 3).alias("total"),
    )


@query(
    "k9_boosting_bound",
    "SELECT 1 AS falls, 1 AS holds, count(*)::BIGINT AS n FROM labels JOIN documents USING (doc_id)",
)
def k9_boosting_bound(spark: SparkSession, sf: str) -> DataFrame:
    """The bound on the training error falls with every round, and the error stays below it."""
    rows = frame(spark, sf)
    stumps = fit_stumps(rows, M.feature_knots(rows, 31), 25)
    bound = training_bound(stumps)
    called = stump_scorer(stumps)(rows)
    wrong = F.avg(((F.col("p") >= 0.5).cast("int") != F.col("label").cast("int")).cast("double"))
    falls = all(b < a for a, b in zip([1.0, *bound], bound))
    return called.agg(F.lit(int(falls)).alias("falls"), (wrong <= bound[-1] + 1e-9).cast("int").alias("holds"), F.count(F.lit(1)).alias("n"))


@query(
    "k4_elastic_net_grid",
    """SELECT alpha, "lambda", 10::BIGINT AS n_fits, 0::BIGINT AS bad_loss
       FROM (SELECT unnest([0.0::DOUBLE, 0.2, 0.4, 0.6, 0.8, 1.0]) AS alpha), (SELECT unnest([0.00001::DOUBLE, 0.0001, 0.001, 0.01]) AS "lambda")""",
)
def k4_elastic_net_grid(spark: SparkSession, sf: str) -> DataFrame:
    cv = V.cross_validate(frame(spark, sf, folds=10), "elastic_net")
    setting = F.from_json("setting", "alpha double, lambda double")
    return cv.results.groupBy(setting["alpha"].alias("alpha"), setting["lambda"].alias("lambda")).agg(
        F.sum("n_fits").alias("n_fits"), _inside("log_loss", 0.0, 40.0).alias("bad_loss")
    )


@query(
    "k5_class_moments",
    """WITH d AS (SELECT toxic, ln(n_chars + 1) AS len, CAST(n_chars AS DOUBLE) AS chars FROM labels JOIN documents USING (doc_id))
       SELECT toxic, count(*) AS n, round(avg(len), 6) AS len_mean, round(var_pop(len), 6) AS len_var,
              round(avg(chars), 3) AS chars_mean, round(var_pop(chars) / 1e6, 3) AS chars_var, round(count(*) / (SELECT count(*) FROM d), 6) AS prior
       FROM d GROUP BY 1""",
)
def k5_class_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.labelled(spark, sf).select(
        "toxic", F.ln(F.col("n_chars") + 1).alias("len"), F.col("n_chars").cast("double").alias("chars")
    )
    out = M.class_moments(rows, "toxic", ["len", "chars"])
    return out.select(
        "toxic", "n", F.round("len_mean", 6).alias("len_mean"), F.round("len_var", 6).alias("len_var"),
        F.round("chars_mean", 3).alias("chars_mean"), F.round(F.col("chars_var") / 1e6, 3).alias("chars_var"), F.round("prior", 6).alias("prior"),
    )


@query(
    "k6_hinge_features",
    """WITH k AS (SELECT quantile_cont(o_totalprice, 0.25) AS k1, quantile_cont(o_totalprice, 0.5) AS k2, quantile_cont(o_totalprice, 0.75) AS k3 FROM orders)
       SELECT o_orderkey, round(greatest(o_totalprice - k1, 0), 4) AS o_totalprice_up1, round(greatest(k1 - o_totalprice, 0), 4) AS o_totalprice_dn1,
              round(greatest(o_totalprice - k2, 0), 4) AS o_totalprice_up2, round(greatest(k2 - o_totalprice, 0), 4) AS o_totalprice_dn2,
              round(greatest(o_totalprice - k3, 0), 4) AS o_totalprice_up3, round(greatest(k3 - o_totalprice, 0), 4) AS o_totalprice_dn3
       FROM orders, k""",
)
def k6_hinge_features(spark: SparkSession, sf: str) -> DataFrame:
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    # Three numbers.
    knots = exact_quantiles(orders, "o_totalprice", {"k1": 0.25, "k2": 0.5, "k3": 0.75}).first()
    wide = X.hinge_features(orders, {"o_totalprice": list(knots)}).drop("o_totalprice")
    return wide.withColumns({c: F.round(c, 4) for c in wide.columns if c != "o_orderkey"})


@query(
    "k13_scale",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM embeddings),
            m AS (SELECT j, avg(x) AS mu, stddev_samp(x) AS sd FROM e GROUP BY j)
       SELECT vec_id, round(sum((x - mu) / sd), 3) AS total, round(sum(((x - mu) / sd) * ((x - mu) / sd)), 3) AS square
       FROM (SELECT vec_id, CAST(x AS DOUBLE) AS x, j FROM e) JOIN m USING (j) GROUP BY 1""",
)
def k13_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(_vectors(spark, sf), "vectors", rebalance=True)
    scaled = M.preprocess(rows, pca_variance=None)(rows)
    x = M.vector_to_array("features")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return scaled.select(F.col("row_id").alias("vec_id"), F.round(total, 3).alias("total"), F.round(square, 3).alias("square"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("label"),
        M.array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


@query(
    "k13_pca",
    "SELECT count(*) AS n, 1 AS one_width, 1 AS narrower, 0::BIGINT AS off_centre FROM embeddings",
)
def k13_pca(spark: SparkSession, sf: str) -> DataFrame:
    """Every row keeps the same number of components, fewer than before, each centred at zero."""
    rows = materialize(_vectors(spark, sf), "vectors", rebalance=True)
    rotated = M.preprocess(rows)(rows)
    x = M.vector_to_array("features")
    width = rotated.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.size(x)).cast("int").alias("one_width"), (F.max(F.size(x)) <= 64).cast("int").alias("narrower")
    )
    means = rotated.select(F.posexplode(x).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("mu"))
    off = means.agg(F.count(F.when(F.abs("mu") > 1e-6, 1))).scalar()
    return width.withColumn("off_centre", off)


@query(
    "k14_permutation_importance",
    "SELECT unnest(['len', 'words', 'lines', 'digits', 'upper', 'lang_de', 'lang_es', 'lang_fr']) AS feature, 1 AS finite",
)
def k14_permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = frame(spark, sf)
    scorer = M.FAMILIES["logit"].fit(rows, {}, 555)
    out = V.permutation_importance(scorer, rows, FEATURES)
    return out.select("feature", (F.abs("importance") < 10).cast("int").alias("finite"))


@query(
    "k15_cross_validate",
    """SELECT 'tree' AS model, count(*) AS n, count(*) AS n_rows, 0::BIGINT AS bad_p, 5::BIGINT AS n_settings, 50::BIGINT AS n_fits
       FROM labels JOIN documents USING (doc_id)""",
)
def k15_cross_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions: every row exactly once."""
    cv = V.cross_validate(frame(spark, sf, folds=10), "tree", parallelism=8)
    tried = cv.results.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("n_fits").alias("fits"))).scalar()
    return cv.predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_rows"), _inside("p").alias("bad_p")
    ).withColumns({"n_settings": tried["n"], "n_fits": tried["fits"]})


@query(
    "k16_tuning_stability",
    """SELECT CAST(i AS INTEGER) AS imp, m AS model, 1::BIGINT AS n, 0::BIGINT AS bad_loss
       FROM (SELECT unnest(range(1, 3)) AS i), (SELECT unnest(['tree', 'logit']) AS m)""",
)
def k16_tuning_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Best setting of two families on two imputations of the masked supplier panel."""
    done = em_impute(
        masked_panel(spark, sf), "row_id", "year", "suppkey", noms=["kind"], ords=["lines"],
        bounds={"total": (0, None), "quantity": (0, None)}, m=2,
    )
    label = (F.col("kind") == "heavy").cast("int")
    parts = None
    for i in (1, 2):
        one = X.model_frame(done.where(F.col("imp") == i), "row_id", label, ["total", "lines", "year"])
        one = G.assign_folds(one, 2, 555, "label", "row_id").withColumn("imp", F.lit(i))
        parts = one if parts is None else parts.unionByName(one)
    stable = V.tuning_stability(materialize(parts, "replicates", rebalance=True), ["imp"], ["tree", "logit"], {"tree": [{"depth": d} for d in (1, 3)]}, parallelism=8)
    return stable.groupBy("imp", "model").agg(F.count(F.lit(1)).alias("n"), _inside("log_loss", 0.0, 40.0).alias("bad_loss"))


# --- the whole modelling path ------------------------------------------------------------------

PATH_MODELS = ("null", "logit", "naive_bayes", "forest")


def out_of_fold(spark: SparkSession, sf: str, families: tuple[str, ...] = PATH_MODELS) -> DataFrame:
    """Out-of-fold predictions of several families on the down-sampled training part."""
    rows = frame(spark, sf, folds=10)
    out = None
    for f in families:
        preds = V.cross_validate(rows, f, [M.FAMILIES[f].grid[0]], parallelism=8).predictions
        out = preds if out is None else out.unionByName(preds)
    return materialize(out, "out-of-fold", rebalance=True)


@query("r6_ensemble_weights", "SELECT 4::BIGINT AS n, 1 AS sums_to_one, 0::BIGINT AS negative, 1 AS no_worse_than_best")
def r6_ensemble_weights(spark: SparkSession, sf: str) -> DataFrame:
    preds = out_of_fold(spark, sf)
    weights = ensemble_weights(preds, PATH_MODELS)
    mixed = blend(preds, weights, "row_id", ["label"])
    scores = score_models(preds.select("row_id", "label", "model", "p").unionByName(mixed))
    w = spark.createDataFrame([(m, float(v)) for m, v in weights.items()], "model string, weight double")
    best = scores.where("model <> 'ensemble'").agg(F.min("log_loss")).scalar()
    mine = scores.where("model = 'ensemble'").select("log_loss").scalar()
    return w.agg(
        F.count(F.lit(1)).alias("n"),
        (F.abs(F.sum("weight") - 1) < 1e-9).cast("int").alias("sums_to_one"),
        F.count(F.when(F.col("weight") < 0, 1)).alias("negative"),
    ).withColumn("no_worse_than_best", (mine <= best + 1e-9).cast("int"))


@query(
    "r8_ablate",
    """SELECT 'forest' AS dropped, count(*) AS n, 1 AS no_better FROM labels JOIN documents USING (doc_id)""",
)
def r8_ablate(spark: SparkSession, sf: str) -> DataFrame:
    """Without one model the fitted ensemble cannot gain on the fit set."""
    preds = out_of_fold(spark, sf)
    full = ablate(preds, PATH_MODELS, []).select("log_loss").scalar()
    less = ablate(preds, PATH_MODELS, ["forest"])
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return less.select("dropped", n.alias("n"), (F.col("log_loss") >= full - 1e-7).cast("int").alias("no_better"))
