import math
import random

import pytest

from lodgewise.operators import evaluate


def scored(spark, rows, model="m"):
    return spark.createDataFrame([(model, y, p, s) for y, p, s in rows], "model string, no_show int, prediction int, score double")


def test_all_right(spark):
    df = scored(spark, [(0, 0, 0.1), (0, 0, 0.2), (1, 1, 0.8), (1, 1, 0.9)])
    out = evaluate.all_metrics(df).first().asDict()
    assert all(out[m] == 1.0 for m in evaluate.METRICS)


def test_all_wrong(spark):
    out = evaluate.all_metrics(scored(spark, [(0, 1, 0.9), (1, 0, 0.1)])).first()
    assert (out["accuracy"], out["precision"], out["recall"], out["f1_score"], out["roc_auc"]) == (0, 0, 0, 0, 0)


def test_nothing_predicted_is_zero_not_an_error(spark):
    out = evaluate.all_metrics(scored(spark, [(0, 0, 0.1), (1, 0, 0.4)])).first()
    assert (out["precision"], out["recall"], out["f1_score"], out["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_one_class_has_no_ranking(spark):
    df = scored(spark, [(1, 1, 0.9), (1, 0, 0.1)])
    assert evaluate.roc_auc(df).first()["roc_auc"] is None
    assert evaluate.confusion_matrix(df).first() == ("m", 0, 0, 1, 1)


def brute(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hits = sum(1 for p in pos if p >= t)
        recall = hits / len(pos)
        ap += (recall - before) * hits / sum(1 for _, s in rows if s >= t)
        before = recall
    return auc, ap


@pytest.mark.parametrize("digits", [1, 3, 17])
def test_ranking_by_brute_force(spark, digits):
    rng = random.Random(digits)
    rows = [(int(rng.random() < 0.3), round(rng.random() ** 3, digits)) for _ in range(300)]
    out = evaluate.ranking_metrics(scored(spark, [(y, 0, s) for y, s in rows])).first()
    auc, ap = brute(rows)
    assert math.isclose(out["roc_auc"], auc, rel_tol=1e-12)
    assert math.isclose(out["pr_auc"], ap, rel_tol=1e-12)


def long(spark, values, model="m"):
    return spark.createDataFrame([(model, k, v) for k, v in values.items()], "model string, metric string, value double")


def test_thresholds_alias_and_override(spark):
    metrics = long(spark, {"roc_auc": 0.85, "f1": 0.55, "precision": 0.8, "accuracy": 0.1})
    checks = {r["metric"]: r["status"] for r in evaluate.threshold_check(metrics).collect()}
    assert checks == {"roc_auc": "PASS", "f1_score": "FAIL", "precision": "PASS"}
    assert not evaluate.passes(evaluate.threshold_check(metrics)).first()["passed"]
    assert evaluate.passes(evaluate.threshold_check(metrics, {"f1": 0.5})).first()["passed"]
    assert not evaluate.passes(evaluate.threshold_check(metrics, {"f1": 0.5, "roc_auc": 0.9})).first()["passed"]


def test_degradation(spark):
    now = long(spark, {"roc_auc": 0.80, "f1_score": 0.70, "recall": 0.5, "accuracy": 0.1})
    then = long(spark, {"roc_auc": 0.82, "f1": 0.75, "accuracy": 0.9})
    out = {r["metric"]: r["degraded"] for r in evaluate.degradation_check(now, then).collect()}
    assert out == {"roc_auc": False, "f1_score": True, "recall": False}
    assert not any(r["degraded"] for r in evaluate.degradation_check(now, then.where("false")).collect())


def test_champion_and_promotion(spark):
    wide = spark.createDataFrame([("b", 0.8), ("a", 0.8), ("c", None)], "model string, roc_auc double")
    assert evaluate.champion(wide).first() == ("a", 0.8)
    schema = "model string, roc_auc double"
    old, same, better = (spark.createDataFrame([r], schema) for r in (("old", 0.8), ("same", 0.8), ("better", 0.81)))
    assert evaluate.promote(old, same).first() == ("old", 0.8, False)
    assert evaluate.promote(old, better).first() == ("better", 0.81, True)
    assert evaluate.promote(old.where("false"), same).first() == ("same", 0.8, True)


def test_long_form_and_back(spark):
    df = scored(spark, [(0, 0, 0.1), (1, 1, 0.8), (1, 0, 0.3)], "x").unionByName(scored(spark, [(0, 1, 0.9), (1, 1, 0.8)], "y"))
    wide = evaluate.all_metrics(df)
    rows = evaluate.metrics_long(wide)
    assert rows.count() == 12
    assert sorted(evaluate.compare_models(rows).collect()) == sorted(wide.select("model", *evaluate.METRICS).collect())
    assert {r["metric"]: r["model"] for r in evaluate.best_per_metric(rows).collect()}["roc_auc"] == "x"


def test_class_report(spark):
    out = {r["label"]: r for r in evaluate.class_report(scored(spark, [(0, 0, 0.1), (0, 1, 0.7), (1, 1, 0.8)])).collect()}
    assert (out["0"]["precision"], out["0"]["recall"], out["0"]["support"]) == (1.0, 0.5, 2)
    assert (out["1"]["precision"], out["1"]["recall"]) == (0.5, 1.0)
    assert math.isclose(out["macro avg"]["recall"], 0.75)
    assert math.isclose(out["weighted avg"]["precision"], (1.0 * 2 + 0.5) / 3)
