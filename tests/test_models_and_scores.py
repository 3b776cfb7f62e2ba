import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import features as X
from pairlens.operators import models as M
from pairlens.operators import sampling as G
from pairlens.operators import scoring as R
from pairlens.operators import validation as V
from pairlens.operators.ensemble import ablate, ensemble_weights

from conftest import as_dict, as_set


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(-(-1.5 + 1.5 * x[:, 0] - np.abs(x[:, 1]))))
    y = (rng.random(n) < p).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "id bigint, y int, a double, b double, c double")
    return X.model_frame(df, "id", F.col("y"), ["a", "b", "c"]).coalesce(1).cache()


def test_derive_features_and_order(rows):
    df = rows([(1, 2, 1871, 6, 7, 4.0, 3, 1, "x"), (1, 2, 1870, 6, 7, 4.0, 3, 0, "x"), (1, 3, 1871, None, 7, 1.0, 0, 0, "x")],
              "a_unit int, b_unit int, year int, A_pol int, B_pol int, ud_dist double, ud_quiet int, B_attacked int, A_id string")
    out = X.derive_features(df, {"ud_joint": ("A_pol", "B_pol", 6)}, ["ud_dist"], {"ud_quiet": [(2, 100), (3, 1000)]}, "B_attacked",
                            drop=["A_id"], lead=["a_unit", "b_unit"], where=F.col("year") > 1870)
    assert out.columns == ["a_unit", "b_unit", "B_attacked", "A_pol", "B_pol", "ud_dist", "ud_quiet", "ud_joint", "ud_quiet2", "ud_quiet3", "year"]
    got = as_set(out, "b_unit", "B_attacked", "ud_joint", "ud_dist", "ud_quiet2", "ud_quiet3")
    assert got == {(2, "yes", 1, math.log(4), 0.09, 0.027), (3, "no", None, 0.0, 0.0, 0.0)}


def test_dummy_encode_reference_level(rows):
    got = X.dummy_encode(rows([("none",), ("direct",), ("odd",), (None,)], "c string"), "c", ["none", "water", "direct"], drop=False)
    assert as_set(got, "c", "c_water", "c_direct") == {("none", 0, 0), ("direct", 0, 1), ("odd", None, None), (None, None, None)}


def test_stratified_split_sizes(rows):
    df = rows([(i, "yes" if i < 10 else "no") for i in range(111)], "id bigint, y string")
    counts = {(r["y"], r["in_split"]): r["count"] for r in G.stratified_split(df, "y", 0.6, 1, "id").groupBy("y", "in_split").count().collect()}
    assert counts == {("yes", True): 6, ("yes", False): 4, ("no", True): 61, ("no", False): 40}
    parts = G.train_eval_test(df, "y", "id")
    assert parts.count() == 111 and parts.where("part = 'train'").count() == 67
    # The same split on another partitioning.
    again = G.train_eval_test(df.repartition(9), "y", "id")
    assert as_set(parts, "id", "part") == as_set(again, "id", "part")


def test_split_when_one_class_is_exhausted(rows):
    df = rows([(i, int(i == 0)) for i in range(20)], "id bigint, y int")
    parts = as_dict(G.train_eval_test(df, "y", "id"), "id", "part")
    assert parts[0] == "train" and len(parts) == 20


def test_folds_are_balanced(rows):
    df = rows([(i, i % 4 == 0) for i in range(100)], "id bigint, y boolean")
    sizes = G.assign_folds(df, 5, 2, "y", "id").groupBy("fold", "y").count().collect()
    assert {r["count"] for r in sizes if r["y"]} == {5} and {r["count"] for r in sizes if not r["y"]} == {15}


def test_resample_sizes_and_weights(rows):
    df = rows([(i, int(i % 10 == 0)) for i in range(100)], "id bigint, y int")
    out = G.resample(df, "y", 5, "id", ratio=30)
    assert out.where("y = 1").count() == 10 and out.where("y = 0").count() == 300
    weights = G.resample(df, "y", 5, "id", ratio=30, as_weights=True)
    assert {r["id"]: r["n_draws"] for r in weights.collect()} == {r["id"]: r["count"] for r in out.groupBy("id").count().collect()}


def test_log_loss_is_finite_at_the_edges(rows):
    df = rows([(1.0, 1.0), (0.0, 0.0)], "y double, p double")
    assert abs(R.log_loss(df, "y", "p").first()[0]) < 1e-12


def test_auc_ties_and_missing_class(rows):
    assert R.auc(rows([(1.0, 0.5), (0.0, 0.5)], "y double, p double"), "y", "p").first()[0] == 0.5
    assert R.auc(rows([(1.0, 0.5)], "y double, p double"), "y", "p").first()[0] is None
    rng = random.Random(6)
    data = [(float(rng.random() < 0.3), rng.randint(0, 20) / 20) for _ in range(300)]
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(R.auc(rows(data, "y double, p double"), "y", "p").first()[0], want)


def test_confusion_without_positive_calls(rows):
    got = R.confusion(rows([(1.0, 0.2), (0.0, 0.1)], "y double, p double"), "y", "p").first()
    assert (got["tp"], got["tn"], got["fp"], got["fn"]) == (0, 1, 0, 1)
    assert got["precision"] is None and got["specificity"] == 1.0 and got["sensitivity"] == 0.0
    edge = rows([(1.0, 0.5)], "y double, p double")
    assert R.confusion(edge, "y", "p").first()["tp"] == 1 and R.confusion(edge, "y", "p", strict=True).first()["tp"] == 0


def test_blend_matrix_reduction_and_board(rows):
    preds = rows([(1, 1.0, "a", 0.8), (1, 1.0, "null", 0.5), (2, 0.0, "a", 0.4), (2, 0.0, "null", 0.5)], "row_id int, label double, model string, p double")
    mixed = R.blend(preds, {"a": 0.75, "null": 0.25}, "row_id", ["label"])
    assert {r["row_id"]: round(r["p"], 9) for r in mixed.collect()} == {1: 0.725, 2: 0.425}
    short = R.blend(preds.where("NOT (row_id = 2 AND model = 'a')"), {"a": 0.75, "null": 0.25})
    assert as_dict(short, "row_id", "p")[2] is None
    wide = R.prediction_matrix(preds, ["null", "a"])
    assert as_set(wide, "row_id", "null", "a") == {(1, 0.5, 0.8), (2, 0.5, 0.4)}
    scores = R.proportional_reduction(R.log_loss(preds, "label", "p", ["model"]))
    red = as_dict(scores, "model", "reduction")
    ll = (-math.log(0.8) - math.log(0.6)) / 2
    assert red["null"] == 0 and math.isclose(red["a"], (math.log(2) - ll) / math.log(2), rel_tol=1e-9)
    board = R.leaderboard(scores.withColumn("seconds", F.lit(90.0)), rows([("a", "Model A")], "model string, label string"), 3).collect()
    assert [r["model"] for r in board] == ["Model A", "null"] and board[0]["minutes"] == 1.5


def test_unit_risk(rows):
    df = rows([(1, 1, 1, 0.5), (1, 1, 1, 0.5), (1, 1, 2, 0.0), (1, 1, 2, 0.2), (2, 1, 1, 1.0)], "u int, y int, imp int, p double")
    got = as_dict(R.unit_risk(df, "u", "y", replicate="imp"), "u", "risk")
    assert math.isclose(got[1], (0.75 + 0.2) / 2) and got[2] > 0.999


@pytest.mark.parametrize("name", sorted(M.FAMILIES))
def test_every_family_gives_probabilities(frame, name):
    preds = M.fit_predict(frame, frame, name).collect()
    assert len(preds) == 400 and all(0 <= r["p"] <= 1 for r in preds)
    if name != "null":
        loss = -np.mean([math.log(max(r["p"] if r["label"] else 1 - r["p"], 1e-12)) for r in preds])
        rate = np.mean([r["label"] for r in preds])
        assert loss < -(rate * math.log(rate) + (1 - rate) * math.log(1 - rate)) + 0.02


def test_logit_meets_the_score_equation(frame):
    got = M.fit_predict(frame, frame, "logit").agg(F.avg("p"), F.avg("label")).first()
    assert abs(got[0] - got[1]) < 1e-4


def test_weights_stand_for_copies(frame):
    heavy = frame.withColumn("weight", F.when(F.col("label") == 1, 3.0).otherwise(1.0))
    copied = heavy.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("k", "weight")
    a = as_dict(M.fit_predict(heavy, frame, "logit"), "row_id", "p")
    b = as_dict(M.fit_predict(copied, frame, "logit"), "row_id", "p")
    assert max(abs(a[i] - b[i]) for i in a) < 1e-3


@pytest.mark.parametrize("name", sorted(M.FAMILIES))
def test_weighted_cross_validation_is_that_of_repeated_rows(frame, name):
    """Losses count a row as often as its weight says; most families also give the same fit."""
    heavy = G.assign_folds(frame, 2, 1, "label", "row_id").withColumn("weight", F.when(F.col("label") == 1, 3.0).otherwise(1.0))
    copied = heavy.withColumn("k", F.explode(F.array_repeat(F.lit(1), F.col("weight").cast("int")))).drop("k", "weight")
    setting = [M.FAMILIES[name].grid[0]]
    a = V.cross_validate(heavy.cache(), name, setting)
    b = V.cross_validate(copied.cache(), name, setting)
    la, lb = (x.results.first()["log_loss"] for x in (a, b))
    # Trees and networks draw bins, rows or batches by position, so their fits agree only roughly.
    assert math.isclose(la, lb, rel_tol=1e-3 if name in ("null", "logit", "elastic_net", "naive_bayes") else 0.15)
    want = R.log_loss(a.predictions, "label", "p", weight="weight").first()[0]
    assert math.isclose(la, want, rel_tol=1e-9)


def test_weighted_scores_are_those_of_repeated_rows(rows):
    data = [(i, float(i % 3 == 0), (i * 7 % 10) / 10, "m", float(1 + i % 4)) for i in range(60)]
    df = rows(data, "row_id int, label double, p double, model string, weight double")
    copied = df.withColumn("k", F.explode(F.array_repeat(F.lit(1), F.col("weight").cast("int")))).drop("k", "weight")
    a, b = R.score_models(df, weight="weight").first().asDict(), R.score_models(copied).first().asDict()
    assert all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a if k != "model")


def test_fractional_weights_are_refused_where_rows_are_repeated(frame):
    with pytest.raises(Exception, match="whole numbers"):
        M.fit_predict(frame.withColumn("weight", F.lit(0.5)), frame, "perceptron").collect()


def test_tuning_by_area(frame):
    folds = G.assign_folds(frame, 3, 1, "label", "row_id").cache()
    cv = V.cross_validate(folds, "tree", [{"depth": 1}, {"depth": 4}], metric="auc")
    areas = [R.auc(V.cross_validate(folds, "tree", [s]).predictions, "label", "p").first()[0] for s in ({"depth": 1}, {"depth": 4})]
    assert cv.best == {"depth": 1 if areas[0] >= areas[1] else 4}


def test_weights_that_still_move_are_not_returned(spark):
    rows = [(i, float(i % 2), m, p) for i in range(40) for m, p in (("a", 0.1 + 0.02 * i), ("b", 0.9 - 0.01 * i))]
    preds = spark.createDataFrame(rows, "row_id int, label double, model string, p double")
    with pytest.raises(RuntimeError, match="converge"):
        ensemble_weights(preds, ["a", "b"], tol=0.0, max_iter=1)


def test_preprocess_keeps_the_wanted_variance(frame):
    scaled = M.preprocess(frame, pca_variance=None)(frame)
    arr = np.array([r[0].toArray() for r in scaled.select("features").collect()])
    assert np.allclose(arr.mean(0), 0, atol=1e-9) and np.allclose(arr.std(0, ddof=1), 1)
    cut = M.preprocess(frame, pca_variance=0.6)(frame).first()["features"]
    assert len(cut) == 2


def test_cross_validation_scores_each_row_once(spark, frame):
    folds = G.assign_folds(frame, 4, 1, "label", "row_id").cache()
    cv = V.cross_validate(folds, "tree", [{"depth": 1}, {"depth": 4}])
    preds = cv.predictions.collect()
    assert sorted(r["row_id"] for r in preds) == list(range(400))
    results = {json.loads(r["setting"])["depth"]: r["log_loss"] for r in cv.results.collect()}
    assert cv.best == min(({"depth": d} for d in results), key=lambda s: results[s["depth"]])
    loss = R.log_loss(cv.predictions, "label", "p").first()[0]
    assert math.isclose(loss, results[cv.best["depth"]], rel_tol=1e-9)


def test_importance_finds_the_signal(frame):
    scorer = M.FAMILIES["logit"].fit(frame, {}, 1)
    got = as_dict(V.permutation_importance(scorer, frame, ["a", "b", "c"]), "feature", "importance")
    assert max(got, key=got.get) == "a" and abs(got["c"]) < 0.05


def test_downsample_curve_shape(frame):
    curve = V.downsample_curve(frame, frame, ratios=(1, 3), reps=2).collect()
    assert len(curve) == 6 and all(0 < r["log_loss"] < 5 and 0.5 < r["auc"] <= 1 for r in curve)
    summary = G.curve_summary(frame.sparkSession.createDataFrame(curve), "ratio", "log_loss")
    assert summary.count() == 3 and all(r["lower"] <= r["mean"] <= r["upper"] for r in summary.collect())


def test_tuning_stability_rows(frame):
    reps = frame.withColumn("imp", F.lit(1)).unionByName(frame.withColumn("imp", F.lit(2)))
    reps = G.assign_folds(reps.withColumn("row_id", F.col("row_id") * 10 + F.col("imp")), 2, 1, "label", "row_id")
    got = V.tuning_stability(reps, ["imp"], ["tree"], {"tree": [{"depth": 1}, {"depth": 3}]})
    assert as_set(got, "imp", "model") == {(1, "tree"), (2, "tree")}


def test_ensemble_weights_beat_a_fine_grid(spark):
    rng = np.random.default_rng(7)
    n = 1500
    truth = rng.beta(1, 4, n)
    y = (rng.random(n) < truth).astype(float)
    noisy = {m: np.clip(1 / (1 + np.exp(-(np.log(truth / (1 - truth)) + rng.normal(0, s, n)))), 1e-6, 1 - 1e-6) for m, s in (("a", 0.4), ("b", 0.6), ("c", 3.0))}
    rows = [(i, float(y[i]), m, float(noisy[m][i])) for m in noisy for i in range(n)]
    preds = spark.createDataFrame(rows, "row_id int, label double, model string, p double")
    w = ensemble_weights(preds, ["a", "b", "c"])
    q = np.column_stack([np.where(y == 1, noisy[m], 1 - noisy[m]) for m in "abc"])

    def loss(v):
        return -np.log(q @ np.array(v)).mean()

    grid = min(loss((i / 100, j / 100, 1 - (i + j) / 100)) for i in range(101) for j in range(101 - i))
    mine = loss([w[m] for m in "abc"])
    assert abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) >= 0
    assert mine <= grid + 1e-7 and all(mine <= loss(e) + 1e-9 for e in np.eye(3))
    less = ablate(preds, ["a", "b", "c"], ["a"]).first()
    assert less["dropped"] == "a" and less["log_loss"] >= mine - 1e-9


def test_radial_svm_scores_equal_the_chain_of_models(frame):
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scaled = M.preprocess(frame, pca_variance=None)(frame)
    lifted = M.fourier_features(3, 100, 1 / 3, 5)(scaled)
    heavy = frame.where("label = 0").count() / frame.where("label = 1").count()
    svm = LinearSVC(weightCol="w", regParam=0.1, maxIter=50).fit(lifted.withColumn("w", F.when(F.col("label") == 1, heavy).otherwise(1.0)))
    margin = svm.transform(lifted).select("row_id", "label", F.slice(vector_to_array("rawPrediction"), 2, 1).alias("m"))
    margin = margin.withColumn("features", array_to_vector("m"))
    want = LogisticRegression(maxIter=50).fit(margin).transform(margin).select("row_id", vector_to_array("probability")[1].alias("p"))
    scored = M.FAMILIES["radial_svm"].fit(frame, {"reg": 0.1}, 5)(frame)
    want, got = as_dict(want, "row_id", "p"), as_dict(scored, "row_id", "p")
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-4) for i in want)
    # The 100 cosines of a row do not leave the task that makes them.
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "margin(" in plan and "project(" not in plan


def test_character_counts_equal_patterns(spark):
    texts = ["", None, "  a\tB\n\n1 ", "\x0b\x0c\r\x1c\x85 Äé 9", "A\n", "\nA", "x", " "]
    patterns = {"blanks": r"\s+", "breaks": "\n", "digits": "[0-9]", "capitals": "[A-Z]"}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).withColumn("found", X.character_counts("text"))
    got = rows.select(*(F.col(f"found.{c}").eqNullSafe(F.regexp_count("text", F.lit(p))) for c, p in patterns.items())).collect()
    assert len(got) == len(texts) and all(all(r) for r in got)
