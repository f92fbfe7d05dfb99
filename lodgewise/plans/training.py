"""Train, cross-validate, tune and compare classifiers on feature vectors."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from pyspark.errors import AnalysisException
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgewise.operators import evaluate
from lodgewise.operators.encode import FEATURES, Preprocessor, feature_names
from lodgewise.operators.runs import RunLog
from lodgewise.operators.split import kfold, named, stratified_split, with_weights
from lodgewise.plans import forest, models
from lodgewise.plans.boosting import BoostedClassifier
from lodgewise.schema import CV_FOLDS, ROLES, SEED
from lodgewise.session import stored
from lodgewise.sources.tables import canonical, write_json

TRIALS = "trial int, fold int, roc_auc double, params string"


@dataclass
class Trained:
    """A fitted classifier with its validation metrics."""

    name: str
    params: dict
    model: object
    metrics: dict[str, float]
    importance: DataFrame | None
    extra: dict = field(default_factory=dict)

    @property
    def results(self) -> dict[str, float]:
        return {**self.metrics, **self.extra}


def evaluator() -> BinaryClassificationEvaluator:
    """ROC-AUC over every distinct score; the default would bin the scores."""
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol=ROLES.target, numBins=0)


def weighted(vectors: DataFrame, name: str, params: dict | None = None) -> DataFrame:
    """Attach the class weights the named model uses, if it uses any."""
    scheme = models.WEIGHTS[name]
    if scheme is None:
        return vectors
    fixed = (params or {}).get("scale_pos_weight", 1.0)
    if scheme == "neg_over_pos" and fixed != 1.0:
        return vectors.withColumn(models.WEIGHT, F.when(F.col(ROLES.target) == 1, float(fixed)).otherwise(1.0))
    return with_weights(vectors, scheme, name=models.WEIGHT)


def scores(model, vectors: DataFrame, name: str) -> DataFrame:
    """``(key, label, model, score, prediction)`` for a fitted classifier."""
    keep = [c for c in (ROLES.key, ROLES.target) if c in vectors.columns]
    return model.transform(vectors).select(
        *keep,
        F.lit(name).alias("model"),
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def importance(spark: SparkSession, model, names: list[str]) -> DataFrame | None:
    """``(feature, importance)``; for a network the mean absolute first-layer weight."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray().tolist()
    elif hasattr(model, "weights"):
        layers = model.getLayers()
        flat = model.weights.toArray()[: layers[0] * layers[1]]
        values = abs(flat.reshape(layers[1], layers[0], order="F")).mean(axis=0).tolist()
    else:
        return None
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def top_importance(table: DataFrame, n: int | None = None) -> DataFrame:
    """Strongest first by absolute value, optionally only the first ``n``."""
    ranked = table.orderBy(F.desc(F.abs("importance")), "feature")
    return ranked.limit(n) if n else ranked


def cross_validate(name: str, params: dict, vectors: DataFrame, folds: int = CV_FOLDS) -> tuple[float, float]:
    """Mean and deviation of ROC-AUC over stratified folds."""
    found = search(name, [params], vectors, folds)
    return mean_and_deviation([auc for _, _, auc in found])


def mean_and_deviation(values: list[float]) -> tuple[float, float]:
    return fmean(values), pstdev(values)


def _params_text(params: dict) -> str:
    return json.dumps(params, sort_keys=True, default=str)


def _trials(spark: SparkSession, folder: str | None) -> dict[tuple[int, int, str], float]:
    """Finished (trial, fold) pairs, by their parameters too."""
    if folder is None:
        return {}
    try:
        rows = spark.read.schema(TRIALS).parquet(f"{folder}/trials").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {(r["trial"], r["fold"], r["params"]): r["roc_auc"] for r in rows}


def search(
    name: str, points: list[dict], vectors: DataFrame, folds: int, folder: str | None = None, parallel: int = 2
) -> list[tuple[int, int, float]]:
    """Out-of-fold ROC-AUC of every point and fold: ``(trial, fold, roc_auc)``.

    Folds are stored once and classes are weighed anew for each point, on the rows it is fitted on. With a ``folder``,
    each finished pair is entered in a table there, and a later search of the same points goes on with those that are missing.
    """
    spark = vectors.sparkSession
    slots = vectors.schema[FEATURES].metadata
    data = stored(kfold(vectors, folds), "folds").withMetadata(FEATURES, slots)
    n_inputs = len(feature_names(vectors))
    known = _trials(spark, folder)
    done = {(t, f): known[t, f, _params_text(p)] for t, p in enumerate(points) for f in range(folds) if (t, f, _params_text(p)) in known}

    def one(trial: int, fold: int) -> float:
        point = points[trial]
        fitted = models.build(name, point, n_inputs).fit(weighted(data.where(F.col("fold") != fold), name, point))
        return float(evaluator().evaluate(scores(fitted, data.where(F.col("fold") == fold), name)))

    open_ = [(t, f) for t in range(len(points)) for f in range(folds) if (t, f) not in done]
    with ThreadPoolExecutor(parallel) as pool:
        running = {pool.submit(one, *pair): pair for pair in open_}
        try:
            for future in as_completed(running):
                trial, fold = running[future]
                done[trial, fold] = future.result()
                if folder is not None:  # one thread appends, so no two jobs write the table at once
                    row = (trial, fold, done[trial, fold], _params_text(points[trial]))
                    spark.createDataFrame([row], TRIALS).coalesce(1).write.mode("append").parquet(f"{folder}/trials")
        except BaseException:
            for future in running:
                future.cancel()
            raise
    return [(t, f, auc) for (t, f), auc in sorted(done.items())]


def data_id(vectors: DataFrame) -> str:
    """Tells one set of training rows from another: their number and a sum over what they hold."""
    n, mark = vectors.agg(F.count("*"), F.sum(F.xxhash64(*vectors.columns).cast("decimal(38,0)"))).first()
    return f"{n}-{mark}"


def fit(name: str, params: dict, vectors: DataFrame, folder: str | None = None):
    """A classifier fitted on weighed rows. With a ``folder``, forests and boosted trees keep what is finished there and go on from it."""
    rows = weighted(vectors, name, params)
    estimator = models.build(name, params, len(feature_names(vectors)))
    if folder is not None and isinstance(estimator, (forest.ForestClassifier, BoostedClassifier)):
        estimator.restartable(folder, data_id(rows))
    return estimator.fit(rows)


def train(
    name: str,
    train_vectors: DataFrame,
    val_vectors: DataFrame,
    params: dict | None = None,
    folds: int = CV_FOLDS,
    folder: str | None = None,
) -> Trained:
    """Cross-validate on train (not with 0 ``folds``, nor the network), fit on train, evaluate on validation."""
    folds = 0 if name == "neural_network" else folds
    full = {**models.defaults(name), **(params or {})}
    extra: dict = {}
    if folds:
        extra["cv_roc_auc_mean"], extra["cv_roc_auc_std"] = cross_validate(name, full, train_vectors, folds)
    model = fit(name, full, train_vectors, folder)
    table = evaluate.all_metrics(scores(model, val_vectors, name)).first()
    metrics = {m: table[m] for m in evaluate.METRICS}
    return Trained(name, full, model, metrics, importance(train_vectors.sparkSession, model, feature_names(train_vectors)), extra)


def tune(
    name: str,
    vectors: DataFrame,
    trials: int = 50,
    folds: int = CV_FOLDS,
    space: dict[str, tuple] | None = None,
    fixed: dict | None = None,
    seed: int = SEED,
    folder: str | None = None,
) -> tuple[dict, float, DataFrame]:
    """Random search by cross-validated ROC-AUC: best parameters, best score, trial table.

    With a ``folder`` a search that was stopped goes on after the last finished (trial, fold); see `search`.
    """
    rng = random.Random(seed)
    points = [{**models.draw(name, rng, space), **(fixed or {})} for _ in range(trials)]
    found = search(name, points, vectors, folds, folder)
    rows = []
    for i, p in enumerate(points):
        mean, std = mean_and_deviation([auc for trial, _, auc in found if trial == i])
        rows.append((i, mean, std, {k: str(v) for k, v in p.items()}))
    table = vectors.sparkSession.createDataFrame(
        rows, "trial int, cv_roc_auc_mean double, cv_roc_auc_std double, params map<string,string>"
    )
    best = max(rows, key=lambda r: r[1])
    return points[best[0]], best[1], table


def tune_and_train(
    name: str, train_vectors: DataFrame, val_vectors: DataFrame, base: dict | None = None, **search
) -> Trained:
    """Tune, then refit with the best parameters over the base ones.

    The search weighs classes by the data, and so does the refit.
    """
    best, score, _ = tune(name, train_vectors, **search)
    done = train(name, train_vectors, val_vectors, {**(base or {}), "scale_pos_weight": 1.0, **best}, folds=0)
    done.extra = {"tuning_best_cv_score": score}
    return done


def results_long(spark: SparkSession, done: list[Trained]) -> DataFrame:
    """``(model, metric, value)`` of several trained models."""
    rows = [(t.name, k, float(v)) for t in done for k, v in t.results.items() if v is not None]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def prepared(raw: DataFrame) -> tuple[Preprocessor, DataFrame, DataFrame, DataFrame]:
    """Split raw bookings, fit preprocessing on train, and vectorise all three parts in one pass.

    Fitting a model reads the vectors once per tree level or iteration, so they are stored, by split.
    """
    whole = stored(stratified_split(canonical(raw)), "split", by="split")
    fitted = Preprocessor.fit(whole.where("split = 'train'").drop("split"))
    vectors = fitted.transform(whole, [ROLES.key, ROLES.target, "split"])
    slots = vectors.schema[FEATURES].metadata
    kept = stored(vectors, "vectors", by="split")
    return fitted, *[part.withMetadata(FEATURES, slots) for part in named(kept)]


def assess(
    raw: DataFrame,
    names: list[str] | None = None,
    params: dict[str, dict] | None = None,
    folds: int = CV_FOLDS,
    log: RunLog | None = None,
    output: str | None = None,
) -> tuple[Preprocessor, list[Trained], DataFrame]:
    """Train and compare the named models (all by default); returns the comparison table too."""
    names = list(names or models.BUILDERS)
    fitted, train_vectors, val_vectors, _ = prepared(raw)
    spark = raw.sparkSession
    parent = log.start("experiment", tags={"n_models": str(len(names))}) if log else None
    done = []
    for name in names:
        done.append(train(name, train_vectors, val_vectors, (params or {}).get(name), folds))
        if log:
            run = log.start(name, parent, {"model_type": name, "tuned": "false"})
            log.log_params(run, {"param": done[-1].params})
            log.log_metrics(run, done[-1].results)
    long = results_long(spark, done)
    if output:
        fitted.save(f"{output}/preprocessor")
        for t in done:
            save_model(t.model, f"{output}/{t.name}")
        write_json(long, f"{output}/results", "overwrite")
    return fitted, done, evaluate.compare_models(long)


def tune_all(
    raw: DataFrame, names: tuple[str, ...] = ("random_forest", "xgboost", "lightgbm"), **search
) -> tuple[Trained, DataFrame]:
    """Tune several models; returns the best by validation ROC-AUC and the long results."""
    _, train_vectors, val_vectors, _ = prepared(raw)
    done = [tune_and_train(n, train_vectors, val_vectors, **search) for n in names]
    return max(done, key=lambda t: t.metrics["roc_auc"] or 0.0), results_long(raw.sparkSession, done)


def retrain(
    raw: DataFrame, name: str, output: str, params: dict | None = None, folds: int = CV_FOLDS, folder: str | None = None
) -> Trained:
    """Refit the champion and save what scoring needs: preprocessor, model and metrics."""
    fitted, train_vectors, val_vectors, _ = prepared(raw)
    done = train(name, train_vectors, val_vectors, params, folds, folder)
    fitted.save(f"{output}/preprocessor")
    save_model(done.model, f"{output}/model")
    write_json(results_long(raw.sparkSession, [done]), f"{output}/metrics", "overwrite")
    return done


save_model, load_model = forest.save, forest.load
