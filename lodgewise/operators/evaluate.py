"""Scores against outcomes: confusion counts, rates, ranking metrics, gates.

Scored frames have ``model`` (who scored), the 0/1 label, a 0/1 ``prediction`` and a ``score``.
Every operator handles all models in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgewise.operators.order_stats import running_totals
from lodgewise.schema import DEGRADATION_TOLERANCE, METRIC_ALIASES, ROLES, THRESHOLDS

LABEL = ROLES.target
METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc"]
BEST_OF = ["roc_auc", "accuracy", "precision", "recall", "f1_score"]


def confusion_matrix(scored: DataFrame) -> DataFrame:
    y, p = F.col(LABEL), F.col("prediction")
    return scored.groupBy("model").agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 per model; an empty denominator gives 0."""
    tn, fp, fn, tp = map(F.col, ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    return confusion_matrix(scored).select(
        "model",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """Exact ROC-AUC and average precision per model, NULL where one class is absent.

    Both follow from the running class counts over distinct scores. AUC: each positive beats the
    negatives below it and half of those at its score. Average precision: the recall gained at a
    score, times the precision of all rows at or above it.
    """
    known = scored.where(F.col(LABEL).isNotNull()).select(
        "model",
        F.col("score").cast("double").alias("score"),
        (F.col(LABEL) == 1).cast("bigint").alias("pos"),
        (F.col(LABEL) == 0).cast("bigint").alias("neg"),
    )
    steps = running_totals(known, ["model"], "score", ["pos", "neg"])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    true_at_or_above = F.col("pos_total") - F.col("pos_before")
    at_or_above = true_at_or_above + F.col("neg_total") - F.col("neg_before")
    return (
        steps.groupBy("model", "pos_total", "neg_total")
        .agg(
            F.sum(pos * (F.col("neg_before") + neg / 2)).alias("wins"),
            F.sum(pos * true_at_or_above / at_or_above).alias("precision_sum"),
        )
        .select(
            "model",
            F.try_divide("wins", F.col("pos_total").cast("double") * F.col("neg_total")).alias("roc_auc"),
            F.try_divide("precision_sum", F.col("pos_total")).alias("pr_auc"),
        )
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored).select("model", "roc_auc")


def average_precision(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored).select("model", "pr_auc")


def all_metrics(scored: DataFrame) -> DataFrame:
    """The comparison table: one row per model with all six metrics."""
    return classification_metrics(scored).join(F.broadcast(ranking_metrics(scored)), "model", "left")


def metrics_long(wide: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """``(model, metric, value)`` rows, without missing values."""
    names = [m for m in (metrics or METRICS) if m in wide.columns]
    return wide.unpivot(["model"], names, "metric", "value").where("value is not null")


def compare_models(long: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Long metrics back to one row per model."""
    return long.groupBy("model").pivot("metric", list(metrics or METRICS)).agg(F.first("value"))


def _best(value: str, model: str = "model") -> Column:
    """Model with the highest value; ties go to the first name."""
    return F.min(F.struct((-F.col(value)).alias("v"), F.col(model).alias("m")))["m"]


def champion(wide: DataFrame) -> DataFrame:
    """Model with the highest ROC-AUC; a missing one counts as 0."""
    known = wide.select("model", F.coalesce("roc_auc", F.lit(0.0)).alias("roc_auc"))
    return known.agg(_best("roc_auc").alias("model"), F.max("roc_auc").alias("roc_auc"))


def best_per_metric(long: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    return (
        long.where(F.col("metric").isin(list(metrics or BEST_OF)))
        .groupBy("metric")
        .agg(_best("value").alias("model"), F.max("value").alias("value"))
    )


def promote(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """The champion after a challenge: the candidate must be strictly better.

    Both are tables ``(model, roc_auc)`` with at most one row; no current champion counts as 0.
    """
    both = current.select("model", "roc_auc", F.lit(0).alias("order")).unionByName(
        candidate.select("model", "roc_auc", F.lit(1).alias("order"))
    )
    worth = F.struct((-F.coalesce("roc_auc", F.lit(0.0))).alias("score"), "order", "model", "roc_auc")
    winner = both.agg(F.min(worth).alias("w"))
    return winner.select(
        F.col("w.model").alias("model"), F.col("w.roc_auc").alias("roc_auc"), (F.col("w.order") == 1).alias("promoted")
    )


def _canonical(metric: Column) -> Column:
    for alias, name in METRIC_ALIASES.items():
        metric = F.when(metric == alias, name).otherwise(metric)
    return metric


def threshold_check(long: DataFrame, custom: dict[str, float] | None = None) -> DataFrame:
    """Gated metrics against their floors; metrics without a value are not gated."""
    floors = {**THRESHOLDS, **{METRIC_ALIASES.get(k, k): v for k, v in (custom or {}).items()}}
    table = long.sparkSession.createDataFrame([(k, float(v)) for k, v in floors.items()], "metric string, threshold double")
    passed = F.col("value") >= F.col("threshold")
    return (
        long.withColumn("metric", _canonical(F.col("metric")))
        .join(F.broadcast(table), "metric")
        .withColumns({"passed": passed, "status": F.when(passed, "PASS").otherwise("FAIL")})
    )


def passes(checks: DataFrame) -> DataFrame:
    """One verdict per model."""
    return checks.groupBy("model").agg(F.bool_and("passed").alias("passed"))


def degradation_check(
    current: DataFrame, baseline: DataFrame, tolerance: float = DEGRADATION_TOLERANCE, metrics: list[str] | None = None
) -> DataFrame:
    """Relative change of gated metrics; without a baseline value a metric passes."""
    gated = list(metrics or THRESHOLDS)
    now = current.withColumn("metric", _canonical(F.col("metric"))).where(F.col("metric").isin(gated))
    then = baseline.withColumn("metric", _canonical(F.col("metric"))).withColumnRenamed("value", "baseline")
    change = F.try_divide(F.col("value") - F.col("baseline"), F.col("baseline"))
    return now.join(then, ["model", "metric"], "left").select(
        "model",
        "metric",
        "baseline",
        F.col("value").alias("current"),
        change.alias("change"),
        F.coalesce(change < -tolerance, F.lit(False)).alias("degraded"),
    )


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per model and class, with macro and weighted averages."""
    tn, fp, fn, tp = map(F.col, ("true_negatives", "false_positives", "false_negatives", "true_positives"))

    def entry(name: str, hit: Column, false_alarm: Column, miss: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            _ratio(hit, hit + false_alarm).alias("precision"),
            _ratio(hit, hit + miss).alias("recall"),
            _ratio(2 * hit, 2 * hit + false_alarm + miss).alias("f1_score"),
            (hit + miss).alias("support"),
        )

    per_class = confusion_matrix(scored).select(
        "model", F.inline(F.array(entry("0", tn, fn, fp), entry("1", tp, fp, fn)))
    )
    rates = ["precision", "recall", "f1_score"]
    support = F.sum("support").alias("support")
    macro = per_class.groupBy("model").agg(
        F.lit("macro avg").alias("label"), *[F.avg(r).alias(r) for r in rates], support
    )
    weighted = per_class.groupBy("model").agg(
        F.lit("weighted avg").alias("label"),
        *[_ratio(F.sum(F.col(r) * F.col("support")), F.sum("support")).alias(r) for r in rates],
        support,
    )
    return per_class.unionByName(macro).unionByName(weighted)
