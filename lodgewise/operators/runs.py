"""Experiment records as tables: runs, params and metrics in long form."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from numbers import Real

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgewise.operators.evaluate import METRICS, best_per_metric, champion
from lodgewise.schema import ROLES, SEED

RUNS = "run_id string, parent_run_id string, name string, tags map<string,string>, started timestamp"
PARAMS = "run_id string, key string, value string"
METRIC_ROWS = "run_id string, metric string, value double"


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    out = []
    for f in schema.fields:
        here = (*path, f.name)
        out += _leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [(here, f.dataType)]
    return out


def _field(path: Sequence[str]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def param_rows(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Nested struct columns to one row per leaf: ``(run_id, key, value)`` with dotted keys."""
    leaves = [p for p, _ in _leaves(df.schema) if p != (run,)]
    cells = [
        F.struct(F.lit(".".join(p)).alias("key"), _field(p).cast("string").alias("value")) for p in leaves
    ]
    return df.select(F.col(run).alias("run_id"), F.inline(F.array(*cells)))


def metric_rows(df: DataFrame, run: str = "run_id", prefix: str = "") -> DataFrame:
    """Numeric leaves to one row each: ``(run_id, metric, value)``; everything else is ignored."""
    leaves = [p for p, t in _leaves(df.schema) if p != (run,) and isinstance(t, T.NumericType)]
    cells = [
        F.struct(F.lit(prefix + ".".join(p)).alias("metric"), _field(p).cast("double").alias("value")) for p in leaves
    ]
    return df.select(F.col(run).alias("run_id"), F.inline(F.array(*cells))).where("value is not null")


def run_tree(runs: DataFrame) -> DataFrame:
    """Each run next to its parent and, for parents, the number of children."""
    parents = runs.select(F.col("run_id").alias("parent_run_id"), F.col("name").alias("parent_name"))
    children = (
        runs.where("parent_run_id is not null")
        .groupBy(F.col("parent_run_id").alias("run_id"))
        .agg(F.count("*").alias("children"))
    )
    return (
        runs.select("run_id", "parent_run_id", "name")
        .join(parents, "parent_run_id", "left")
        .join(children, "run_id", "left")
        .select("run_id", "name", "parent_run_id", "parent_name", F.coalesce("children", F.lit(0)).alias("children"))
    )


def search_runs(
    runs: DataFrame,
    metrics: DataFrame,
    where: str | Column | None = None,
    order_by: Sequence[Column] | None = None,
    max_results: int | None = None,
    names: Sequence[str] = tuple(METRICS),
) -> DataFrame:
    """Runs with their metrics as columns, filtered, best ROC-AUC first; all of them unless ``max_results`` is given."""
    wide = metrics.groupBy("run_id").pivot("metric", list(names)).agg(F.max("value"))
    found = runs.join(wide, "run_id", "left")
    if where is not None:
        found = found.where(where)
    ordered = found.orderBy(*(order_by or [F.desc_nulls_last("roc_auc"), F.col("run_id")]))
    return ordered if max_results is None else ordered.limit(max_results)


def run_data_stats(df: DataFrame, n_features: int, split: str = "split", target: str = ROLES.target) -> DataFrame:
    """What an experiment logs about its data, as a nested row."""
    return df.agg(
        F.struct(
            F.count_if(F.col(split) == "train").alias("train_samples"),
            F.count_if(F.col(split) == "val").alias("val_samples"),
            F.lit(n_features).alias("n_features"),
            F.avg(F.when(F.col(split) == "train", F.col(target))).alias("train_positive_rate"),
            F.avg(F.when(F.col(split) == "val", F.col(target))).alias("val_positive_rate"),
        ).alias("data"),
        F.struct(F.lit(SEED).alias("random_state")).alias("config"),
    )


def experiment_summary(wide: DataFrame) -> DataFrame:
    """Scalar results per model, next to the best model of the experiment."""
    best = champion(wide)
    metrics = [m for m in METRICS if m in wide.columns]
    n = wide.agg(F.count("*").alias("n")).scalar()
    name = best.select("model").scalar()
    return wide.select(
        "model", *metrics, n.alias("n_models"), name.alias("best_model"), (F.col("model") == name).alias("is_best")
    )


def comparison_metrics(long: DataFrame) -> DataFrame:
    """The parent run's record: ``best_<metric>`` values and the models that hold them."""
    return best_per_metric(long).select(F.concat(F.lit("best_"), "metric").alias("metric"), "model", "value")


def flatten(params: dict, parent: str = "") -> dict:
    """Nested parameters to dotted keys."""
    out: dict = {}
    for k, v in params.items():
        key = f"{parent}.{k}" if parent else str(k)
        out.update(flatten(v, key) if isinstance(v, dict) else {key: v})
    return out


class RunLog:
    """Append-only record of runs under one folder, as three parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def start(self, name: str, parent: str | None = None, tags: dict[str, str] | None = None) -> str:
        from datetime import datetime, timezone

        run = uuid.uuid4().hex
        tags = {k: str(v) for k, v in (tags or {}).items()}
        self._append("runs", [(run, parent, name, tags, datetime.now(timezone.utc))], RUNS)
        return run

    def log_params(self, run: str, params: dict) -> None:
        self._append("params", [(run, k, str(v)) for k, v in flatten(params).items()], PARAMS)

    def log_metrics(self, run: str, metrics: dict, prefix: str = "") -> None:
        numbers = {k: v for k, v in metrics.items() if isinstance(v, Real)}
        self._append("metrics", [(run, prefix + k, float(v)) for k, v in numbers.items()], METRIC_ROWS)

    def table(self, name: str) -> DataFrame:
        schema = {"runs": RUNS, "params": PARAMS, "metrics": METRIC_ROWS}[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def search(self, where: str | Column | None = None, max_results: int | None = None) -> DataFrame:
        return search_runs(self.table("runs"), self.table("metrics"), where, max_results=max_results)
