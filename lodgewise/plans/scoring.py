"""Batch scoring of raw bookings with saved artefacts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgewise.operators.encode import FEATURES, Preprocessor
from lodgewise.plans.training import load_model
from lodgewise.sources.tables import write_parquet

# Lower limits of the risk bands.
HIGH_RISK, MEDIUM_RISK = 0.7, 0.4


def risk_band(probability: Column) -> Column:
    return F.when(probability > HIGH_RISK, "HIGH").when(probability > MEDIUM_RISK, "MEDIUM").otherwise("LOW")


def score(raw: DataFrame, preprocessor: Preprocessor, model) -> DataFrame:
    """The input rows with ``noshow_prob`` and ``prediction``; no join, no target needed.

    The raw columns ride along in a struct while the pipeline rewrites their namesakes.
    """
    carried = raw.withColumn("_raw", F.struct(*raw.columns))
    vectors = preprocessor.transform(carried, ["_raw"])
    return model.transform(vectors).select(
        "_raw.*",
        vector_to_array("probability")[1].alias("noshow_prob"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def score_summary(scored: DataFrame) -> DataFrame:
    """How many no-shows are predicted, and their share."""
    return scored.agg(
        F.count("*").alias("bookings"),
        F.sum("prediction").alias("predicted_no_shows"),
        F.avg("prediction").alias("predicted_rate"),
    )


def batch_inference(raw: DataFrame, artefacts: str, output: str | None = None) -> DataFrame:
    """Score with the preprocessor and model saved by ``retrain``; optionally write parquet."""
    fitted = Preprocessor.load(raw.sparkSession, f"{artefacts}/preprocessor")
    scored = score(raw, fitted, load_model(f"{artefacts}/model"))
    if output:
        write_parquet(scored, output, "overwrite")
        return raw.sparkSession.read.schema(scored.schema).parquet(output)
    return scored


__all__ = ["FEATURES", "batch_inference", "risk_band", "score", "score_summary"]
