"""Jobs for spark-submit: ``spark-submit --py-files lodgewise.zip run.py JOB ...``, or
``python -m lodgewise JOB ...``. Inputs are parquet folders with the booking columns, or CSV files
with a header for the monitoring jobs."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lodgewise.operators import evaluate
from lodgewise.operators.runs import RunLog
from lodgewise.plans import monitoring, scoring, training
from lodgewise.schema import CV_FOLDS, DEGRADATION_TOLERANCE
from lodgewise.sources import tables

METRIC_ROWS = "model string, metric string, value double"


def _frame(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodgewise", description="Booking analytics jobs")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, text: str) -> argparse.ArgumentParser:
        return jobs.add_parser(name, help=text)

    assess = job("assess", "train and compare models")
    tune = job("tune", "search parameters and name the best model")
    retrain = job("retrain", "refit the champion and save what scoring needs")
    for p in (assess, tune, retrain):
        p.add_argument("--bookings", required=True)
    for p in (assess, tune):
        p.add_argument("--models", nargs="+")
    for p in (assess, retrain):
        p.add_argument("--output", required=True)
        p.add_argument("--folds", type=int, default=CV_FOLDS)
    assess.add_argument("--runs", help="folder of the run log")
    tune.add_argument("--trials", type=int, default=20)
    retrain.add_argument("--model", default="random_forest")
    for p in (tune, retrain):
        p.add_argument("--resume", help="folder of finished trials or forest parts; a stopped job goes on from them")

    score = job("score", "score bookings with saved artefacts")
    score.add_argument("--bookings", required=True)
    score.add_argument("--query", help="SQL over the bookings, registered as noshow")
    score.add_argument("--artefacts", required=True)
    score.add_argument("--output", required=True)

    drift = job("drift", "compare a reference and a current frame")
    drift.add_argument("--reference", required=True)
    drift.add_argument("--current", required=True)
    drift.add_argument("--output", required=True)

    check = job("check", "gate metrics against floors and a baseline")
    check.add_argument("--metrics", required=True)
    check.add_argument("--baseline")
    check.add_argument("--threshold", type=float, default=DEGRADATION_TOLERANCE)
    check.add_argument("--alert-on-degradation", action="store_true")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one job; the result is the exit code."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"lodgewise-{args.job}").getOrCreate()
    if args.job == "assess":
        log = RunLog(spark, args.runs) if args.runs else None
        raw = _frame(spark, args.bookings)
        _, _, table = training.assess(raw, args.models, folds=args.folds, log=log, output=args.output)
        table.show(truncate=False)
    elif args.job == "tune":
        names = tuple(args.models) if args.models else ("random_forest", "xgboost", "lightgbm")
        best, _ = training.tune_all(_frame(spark, args.bookings), names, trials=args.trials, folder=args.resume)
        print(best.name, best.params, best.results)
    elif args.job == "retrain":
        done = training.retrain(_frame(spark, args.bookings), args.model, args.output, folds=args.folds, folder=args.resume)
        print(done.name, done.results)
    elif args.job == "score":
        raw = tables.register(_frame(spark, args.bookings))
        raw = tables.load(spark, args.query) if args.query else raw
        scored = scoring.batch_inference(raw, args.artefacts, args.output)
        scoring.score_summary(scored).show()
    elif args.job == "drift":
        _, summary = monitoring.monitor_drift(_frame(spark, args.reference), _frame(spark, args.current), output=args.output)
        summary.show(truncate=False)
        return int(summary.first()["critical_drift"])
    else:
        return _check(spark, args)
    return 0


def _check(spark: SparkSession, args: argparse.Namespace) -> int:
    """0 if all floors hold and, when asked, nothing degraded."""
    metrics = spark.read.schema(METRIC_ROWS).json(args.metrics)
    baseline = spark.read.schema(METRIC_ROWS).json(args.baseline) if args.baseline else metrics.where("false")
    checks = evaluate.threshold_check(metrics)
    changes = evaluate.degradation_check(metrics, baseline, args.threshold)
    checks.show(truncate=False)
    changes.show(truncate=False)
    failed = checks.where("not passed").count() > 0 or metrics.isEmpty()
    degraded = changes.where("degraded").count() > 0
    return int(failed or (degraded and args.alert_on_degradation))


if __name__ == "__main__":
    raise SystemExit(main())
