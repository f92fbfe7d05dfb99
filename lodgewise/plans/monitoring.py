"""Monitoring jobs: drift between two frames, and model quality on labelled data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgewise.operators import drift, evaluate
from lodgewise.schema import ROLES
from lodgewise.session import stored
from lodgewise.sources.tables import infer_roles, write_json


def monitor_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    output: str | None = None,
    methods: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Column scores and their summary, computed once. Key and target are not features."""
    if numeric is None or categorical is None:
        inferred = infer_roles(reference, exclude=(ROLES.key,))
        numeric = inferred[0] if numeric is None else numeric
        categorical = inferred[1] if categorical is None else categorical
    columns = stored(drift.column_drift(reference, current, numeric, categorical, methods), "drift")
    summary = drift.drift_summary(columns)
    if output:
        write_json(columns, f"{output}/columns", "overwrite")
        write_json(summary, f"{output}/summary", "overwrite")
    return columns, summary


def monitor_model(
    scored: DataFrame,
    baseline: DataFrame | None = None,
    thresholds: dict[str, float] | None = None,
    output: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long metrics, threshold checks and degradation checks of scored, labelled rows.

    Without a baseline nothing counts as degraded.
    """
    metrics = stored(evaluate.metrics_long(evaluate.all_metrics(scored)), "metrics")
    empty = metrics.where(F.lit(False))
    checks = evaluate.threshold_check(metrics, thresholds)
    degraded = evaluate.degradation_check(metrics, baseline if baseline is not None else empty)
    if output:
        write_json(metrics, f"{output}/metrics", "overwrite")
    return metrics, checks, degraded
