import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lodgewise.operators import encode, evaluate, split
from lodgewise.operators.runs import RunLog
from lodgewise.plans import models, monitoring, scoring, training
from lodgewise.schema import CV_FOLDS, SEED

SMALL = {
    "random_forest": {"n_estimators": 8, "max_depth": 4, "max_features": "sqrt", "min_samples_leaf": 2},
    "xgboost": {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "min_child_weight": 1},
    "lightgbm": {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3},
    "neural_network": {"hidden_layers": [8], "epochs": 60, "batch_size": 32},
}


@pytest.fixture(scope="module")
def fitted(clean_bookings):
    return training.prepared(clean_bookings)


def test_unknown_models_are_refused():
    with pytest.raises(ValueError, match="no model is called"):
        models.build("tabnet")


def test_parameters_reach_the_estimators(spark):
    with pytest.raises(ValueError, match="max_depth 99"):
        models.build("random_forest", {"max_depth": 99})
    forest = models.build("random_forest")
    assert forest.getMaxDepth() == 22 and forest.getNumTrees() == 563 and forest.getFeatureSubsetStrategy() == "0.8"
    boosted = models.build("lightgbm").settings
    assert boosted.min_child_samples == 5 and boosted.num_leaves == 282 and boosted.reg_alpha > 0
    assert models.build("xgboost").settings.gamma > 0 and models.build("xgboost").settings.num_leaves == 0
    tuned = {"n_layers": 2, "n_units_l0": 7, "n_units_l1": 3}
    assert models.build("neural_network", tuned, 5).getLayers() == [5, 7, 3, 2]


def test_draws_are_seeded_and_inside_the_space():
    for name in models.SPACES:
        a, b = (models.draw(name, random.Random(1)) for _ in range(2))
        assert a == b
    point = models.draw("xgboost", random.Random(3))
    assert 3 <= point["max_depth"] <= 12 and 0.005 <= point["learning_rate"] <= 0.3


@pytest.mark.parametrize("name", list(SMALL))
def test_separable_data_is_learnt(spark, name):
    rng = random.Random(4)
    rows = [(i, float(y), [rng.gauss(4 * y, 1), rng.gauss(-4 * y, 1)]) for i, y in enumerate([0, 1] * 50)]
    df = spark.createDataFrame(rows, "booking_id long, no_show double, v array<double>").select(
        "booking_id", F.col("no_show").cast("int").alias("no_show"), array_to_vector("v").alias("features")
    )
    data = training.weighted(df, name)
    model = models.build(name, SMALL[name], 2).fit(data)
    scored = training.scores(model, df, name)
    assert evaluate.all_metrics(scored).first()["accuracy"] > 0.9
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1
    assert training.importance(spark, model, ["a", "b"]).count() == 2


def test_vectors_have_the_same_slots_everywhere(fitted):
    _, train, val, test = fitted
    names = encode.feature_names(train)
    assert names == encode.feature_names(val) == encode.feature_names(test)
    assert len(names) == len(set(names)) and names[0] == "price" and "branch_Ridge" in names and names[-1] == "first_time"
    assert train.count() + val.count() + test.count() == 640


def test_scaled_training_numbers_are_standard(fitted):
    from pyspark.ml.functions import vector_to_array

    _, train, _, _ = fitted
    price = vector_to_array("features")[0]
    mean, std = train.agg(F.avg(price), F.stddev_pop(price)).first()
    assert abs(mean) < 1e-9 and abs(std - 1) < 1e-9


def test_unseen_categories_are_all_zero(spark, clean_bookings):
    other = clean_bookings.limit(3).withColumn("branch", F.lit("MARS"))
    hot = encode.one_hot(clean_bookings, other, ["branch"])
    assert all(r["branch__hot"].numNonzeros() == 0 and r["branch__hot"].size == 3 for r in hot.collect())


def test_train_validate_and_beat_chance(fitted, spark):
    _, train, val, _ = fitted
    done = training.train("random_forest", train, val, SMALL["random_forest"], folds=2)
    assert done.metrics["roc_auc"] > 0.5
    assert {"cv_roc_auc_mean", "cv_roc_auc_std"} <= set(done.extra)
    assert done.importance.count() == len(encode.feature_names(train))
    top = training.top_importance(done.importance, 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"] >= top[2]["importance"]


def test_tuning_returns_the_best_trial(fitted):
    _, train, _, _ = fitted
    space = {"n_estimators": ("int", 2, 4), "max_depth": ("int", 2, 3)}
    best, score, trials = training.tune("random_forest", train, trials=2, folds=2, space=space, fixed={"max_features": "sqrt"})
    assert set(best) == {"n_estimators", "max_depth", "max_features"}
    assert score == max(r["cv_roc_auc_mean"] for r in trials.collect())


def test_tuned_models_are_refitted(fitted):
    _, train, val, _ = fitted
    space = {"n_estimators": ("int", 2, 3), "max_depth": ("int", 2, 2), "learning_rate": ("log", 0.1, 0.3)}
    done = training.tune_and_train("xgboost", train, val, trials=1, folds=2, space=space)
    assert done.params["max_depth"] == 2 and done.params["scale_pos_weight"] == 1.0
    assert 0 <= done.extra["tuning_best_cv_score"] <= 1 and done.metrics["roc_auc"] > 0.5


def test_retrain_save_score_and_monitor(spark, clean_bookings, tmp_path):
    out = str(tmp_path / "champion")
    training.retrain(clean_bookings, "random_forest", out, SMALL["random_forest"])
    unlabelled = clean_bookings.drop("no_show")
    scored = scoring.batch_inference(unlabelled, out, str(tmp_path / "scores"))
    assert scored.columns == [*unlabelled.columns, "noshow_prob", "prediction"]
    # the input rows come back as they were
    assert sorted(scored.select(*unlabelled.columns).collect()) == sorted(unlabelled.collect())
    summary = scoring.score_summary(scored).first()
    assert summary["bookings"] == 640 and 0 <= summary["predicted_rate"] <= 1
    bands = scored.select("noshow_prob", scoring.risk_band(F.col("noshow_prob")).alias("band")).collect()
    assert all((b == "HIGH") == (p > 0.7) and (b == "LOW") == (p <= 0.4) for p, b in bands)
    labelled = scored.join(clean_bookings.select("booking_id", "no_show"), "booking_id").select(
        F.lit("rf").alias("model"), "no_show", "prediction", F.col("noshow_prob").alias("score")
    )
    metrics, checks, degraded = monitoring.monitor_model(labelled, output=str(tmp_path / "reports"))
    assert metrics.count() == 6 and checks.count() == 4
    assert not any(r["degraded"] for r in degraded.collect())
    assert spark.read.json(str(tmp_path / "reports/metrics")).count() == 6


def test_assessment_compares_and_logs(spark, clean_bookings, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    _, done, table = training.assess(clean_bookings, ["random_forest", "lightgbm"], SMALL, folds=0, log=log)
    assert [t.name for t in done] == ["random_forest", "lightgbm"]
    assert table.count() == 2
    found = log.search("parent_run_id is not null").collect()
    assert len(found) == 2 and found[0]["roc_auc"] >= found[1]["roc_auc"]


def test_weights_follow_the_model(spark):
    df = spark.createDataFrame([(1, 0)] * 3 + [(2, 1)], "booking_id int, no_show int")
    weights = {n: {r["no_show"]: r["weight"] for r in training.weighted(df, n).collect()} for n in ("random_forest", "xgboost")}
    assert weights["random_forest"] == {0: 4 / 6, 1: 2.0}
    assert weights["xgboost"] == {0: 1.0, 1: 3.0}
    fixed = training.weighted(df, "xgboost", {"scale_pos_weight": 9.0}).where("no_show = 1").first()
    assert fixed["weight"] == 9.0
    assert split.class_weights(df).count() == 2


def test_registered_models_are_the_published_ones(spark, monkeypatch):
    from checks import queries

    fits, searches = {}, []

    def fit(name, train, val, params=None, folds=CV_FOLDS):
        fits[name] = {**models.defaults(name), **(params or {})}
        return training.Trained(name, {}, None, {}, None)

    def search(name, points, vectors, folds, folder=None):
        searches.append((name, points, folds))
        return [(t, f, 0.5) for t in range(len(points)) for f in range(folds)]

    monkeypatch.setattr(queries, "vectors", lambda spark, folder: (None, spark.range(0), None, None))
    monkeypatch.setattr(training, "train", fit)
    monkeypatch.setattr(training, "search", search)
    every = queries.QUERIES | queries.LONG_QUERIES
    for key in ("model_random_forest", "model_gbt", "model_gbt_balanced", "model_mlp", "cv_summary"):
        every[key](spark, "published")
    for name in models.BUILDERS:
        assert fits[name] == models.defaults(name)
        every[f"tune_{name}"](spark, "published")
    assert searches[0] == ("random_forest", [models.defaults("random_forest")], CV_FOLDS)
    for name, points, folds in searches[1:]:
        rng = random.Random(SEED)
        assert points == [models.draw(name, rng) for _ in range(50)] and folds == CV_FOLDS


def test_forest_of_parts_is_one_model(fitted, spark, tmp_path):
    _, train, val, _ = fitted
    params = {**models.defaults("random_forest"), "n_estimators": 11, "max_depth": 4}
    estimator = models.build("random_forest", params)
    estimator.part_trees = 4
    model = estimator.fit(training.weighted(train, "random_forest"))
    assert [p.getNumTrees for p in model.parts] == [4, 4, 3] and model.trees == 11
    # every tree votes once, whichever part it is in
    from pyspark.ml.functions import vector_to_array

    trees = [t for p in model.parts for t in p.trees]
    assert len({t.toDebugString.split("\n", 1)[1] for t in trees}) > 8
    out = val
    for i, t in enumerate(trees):
        out = t.setProbabilityCol(f"t{i}").setRawPredictionCol("").setPredictionCol("").transform(out)
    mean = sum(vector_to_array(f"t{i}")[1] for i in range(11)) / 11
    pairs = model.transform(out.withColumn("mean", mean)).select("mean", vector_to_array("probability")[1], "prediction").collect()
    assert pairs and all(abs(a - b) < 1e-9 and (p == 1.0) == (b > 0.5) for a, b, p in pairs)
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9
    training.save_model(model, str(tmp_path / "forest"))
    again = training.load_model(str(tmp_path / "forest"))
    key = lambda m: {r["booking_id"]: r["score"] for r in training.scores(m, val, "rf").collect()}
    assert again.trees == 11 and key(again) == key(model)


def test_rows_keep_their_nodes_and_trees_stay_the_same(fitted, spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    from lodgewise.plans import forest

    _, train, _, _ = fitted
    rows = training.weighted(train, "random_forest").coalesce(1)
    estimator = models.build("random_forest", {**models.defaults("random_forest"), "n_estimators": 3})
    real, kept = RandomForestClassifier._fit, []

    def fit(self, data):
        kept.append(self.getCacheNodeIds())
        return real(self, data)

    monkeypatch.setattr(RandomForestClassifier, "_fit", fit)
    grown = estimator.fit(rows).parts[0]
    assert kept == [True] and spark.sparkContext.getCheckpointDir()
    plain = RandomForestClassifier()
    estimator._copyValues(plain)
    walked = plain.setMaxMemoryInMB(forest.NODE_MEMORY_MB).setCacheNodeIds(False).fit(rows)
    text = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.trees]
    assert kept == [True, False] and text(grown) == text(walked)


def test_forest_tasks_have_many_rows_but_a_bound(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from lodgewise.plans import forest

    class Seen(Exception):
        pass

    def part(self, rows, part, trees):
        raise Seen(rows.count(), rows.rdd.getNumPartitions())

    monkeypatch.setattr(forest.ForestClassifier, "_part", part)
    point = spark.createDataFrame([(Vectors.dense([1.0]), 1.0)], ["features", "weight"])
    for n, tasks in ((120_000, 1), (450_000, 3)):  # node histograms are shuffled once a task
        rows = spark.range(0, n, 1, 10).select((F.col("id") % 2).cast("int").alias("no_show")).crossJoin(F.broadcast(point))
        with pytest.raises(Seen) as seen:
            models.build("random_forest", {"n_estimators": 1}).fit(rows)
        assert seen.value.args == (n, tasks)


def test_stopped_forest_goes_on_from_its_parts(fitted, spark, tmp_path, monkeypatch):
    from lodgewise.plans.forest import ForestClassifier

    _, train, val, _ = fitted
    params = {**models.defaults("random_forest"), "n_estimators": 9, "max_depth": 3}
    rows = training.weighted(train, "random_forest")
    real, fitted_parts = ForestClassifier._part, []

    def build():
        return models.build("random_forest", params).restartable(str(tmp_path / "fit"), training.data_id(rows), 3)

    def failing(self, data, part, trees):
        if part == 2 and len(fitted_parts) < 3:
            raise RuntimeError("stopped")
        fitted_parts.append(part)
        return real(self, data, part, trees)

    monkeypatch.setattr(ForestClassifier, "_part", failing)
    monkeypatch.setattr(ForestClassifier, "parallel", 1)
    with pytest.raises(RuntimeError, match="stopped"):
        build().fit(rows)
    assert fitted_parts == [0, 1]
    fitted_parts.append("again")
    resumed = build().fit(rows)
    assert fitted_parts == [0, 1, "again", 2] and resumed.trees == 9
    monkeypatch.setattr(ForestClassifier, "_part", real)
    whole = models.build("random_forest", params)
    whole.part_trees = 3
    a, b = (sorted(training.scores(m, val, "rf").collect()) for m in (resumed, whole.fit(rows)))
    assert a == b
    # other rows or parameters start anew
    other = models.build("random_forest", {**params, "max_depth": 2}).restartable(str(tmp_path / "fit"), training.data_id(rows), 3)
    assert other._finished(rows) == set()


def test_stopped_search_goes_on(fitted, tmp_path, monkeypatch):
    _, train, _, _ = fitted
    points = [{"n_estimators": n, "max_depth": 2, "class_weight": "balanced"} for n in (2, 3)]
    real, calls = models.build, []

    def build(name, params=None, n_inputs=0):
        calls.append(params["n_estimators"])
        if len(calls) == 4:
            raise RuntimeError("stopped")
        return real(name, params, n_inputs)

    monkeypatch.setattr(models, "build", build)
    folder = str(tmp_path / "search")
    with pytest.raises(RuntimeError, match="stopped"):
        training.search("random_forest", points, train, 2, folder, parallel=1)
    found = training.search("random_forest", points, train, 2, folder, parallel=1)
    assert calls == [2, 2, 3, 3, 3] and [(t, f) for t, f, _ in found] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert found == training.search("random_forest", points, train, 2, folder) and len(calls) == 5
    assert all(0 <= auc <= 1 for _, _, auc in found)


def test_each_trial_has_weights_of_its_own(fitted, monkeypatch):
    _, train, _, _ = fitted
    seen = []
    real = training.weighted
    monkeypatch.setattr(training, "weighted", lambda v, n, p=None: seen.append(p["scale_pos_weight"]) or real(v, n, p))
    points = [{"n_estimators": 1, "max_depth": 2, "learning_rate": 0.1, "scale_pos_weight": w} for w in (2.0, 9.0)]
    training.search("xgboost", points, train, 2)
    assert sorted(seen) == [2.0, 2.0, 9.0, 9.0]


def test_jobs_cross_validate_unless_told_otherwise():
    from lodgewise.__main__ import _parser

    for job in ("assess", "retrain"):
        assert _parser().parse_args([job, "--bookings", "b", "--output", "o"]).folds == CV_FOLDS
