"""From feature columns to a model vector: median fill, scaling, one-hot, assembly."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgewise.functions.features import engineer
from lodgewise.operators import impute
from lodgewise.operators.order_stats import column_medians
from lodgewise.schema import ROLES, USD_TO_SGD, Roles
from lodgewise.session import stored

FEATURES = "features"
MISSING = "missing"


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; a column without values has none."""
    return {r["column"]: r["median"] for r in column_medians(df, columns).collect()}


def median_impute(df: DataFrame, columns: Sequence[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Fill gaps with medians of the same frame, or with given ones."""
    values = fit_medians(df, columns) if medians is None else medians
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(values.get(c))) for c in columns})


def fit_scale(df: DataFrame, columns: Sequence[str], medians: dict[str, float] | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, after the median fill if medians are given.

    One row of aggregates reaches the driver. A constant column keeps its unit.
    """

    def filled(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.coalesce(value, F.lit(medians.get(c))) if medians else value

    row = df.agg(
        *[F.avg(filled(c)).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(filled(c)).alias(f"{c}__std") for c in columns],
    ).first()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"] or 1.0) for c in columns}


def standard_scale(df: DataFrame, columns: Sequence[str], scale: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(x - mean) / deviation, by statistics of the same frame or given ones."""
    fitted = scale or fit_scale(df, columns)
    return df.withColumns({c: (F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1]) for c in columns})


def _one_hot_stages(columns: Sequence[str], suffix: str = "") -> list:
    """Alphabetical indices and indicator vectors; values never seen in fitting become all zeros."""
    indexed = [f"{c}__index" for c in columns]
    return [
        StringIndexer(
            inputCols=[f"{c}{suffix}" for c in columns],
            outputCols=indexed,
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}__hot" for c in columns], dropLast=True),
    ]


def one_hot(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Indicator vectors ``<column>__hot`` with the categories of ``train``; NULL is ``missing``."""
    model = Pipeline(stages=_one_hot_stages(columns)).fit(impute.fill_constant(train, columns))
    return model.transform(impute.fill_constant(df, columns)).drop(*[f"{c}__index" for c in columns])


def assembler(roles: Roles = ROLES) -> VectorAssembler:
    """Scaled numbers, indicators and flags into one vector; all other columns stay out of it."""
    parts = [f"{c}__num" for c in roles.numerical] + [f"{c}__hot" for c in roles.categorical] + list(roles.binary)
    return VectorAssembler(inputCols=parts, outputCol=FEATURES)


def _prepare_statement(roles: Roles, medians: dict, scale: dict) -> str:
    def number(x: float) -> str:
        return f"CAST('{x!r}' AS DOUBLE)"

    columns = [
        f"(COALESCE(CAST({c} AS DOUBLE), {number(medians.get(c, 0.0))}) - {number(scale[c][0])})"
        f" / {number(scale[c][1])} AS {c}__num"
        for c in roles.numerical
    ]
    columns += [f"COALESCE(CAST({c} AS STRING), '{MISSING}') AS {c}__cat" for c in roles.categorical]
    return f"SELECT *, {', '.join(columns)} FROM __THIS__"


def fit_vectors(features: DataFrame, roles: Roles = ROLES) -> PipelineModel:
    """Fit the whole vector pipeline on training features. Reads them a few times."""
    medians = fit_medians(features, roles.numerical)
    scale = fit_scale(features, roles.numerical, medians)
    scale = {c: (mean if mean is not None else 0.0, std) for c, (mean, std) in scale.items()}
    stages = [SQLTransformer(statement=_prepare_statement(roles, medians, scale))]
    stages += _one_hot_stages(roles.categorical, "__cat")
    stages.append(assembler(roles))
    return Pipeline(stages=stages).fit(features)


def feature_names(vectors: DataFrame) -> list[str]:
    """Names of the vector slots, from the column's metadata."""
    groups = vectors.schema[FEATURES].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in groups.values() for a in group)
    return [name.replace("__num", "").replace("__hot", "") for _, name in slots]


def features_of(df: DataFrame, tables: impute.ImputationTables | None, rate: float = USD_TO_SGD) -> DataFrame:
    """Raw bookings to feature columns, with given fill tables (None leaves the gaps).

    Most features need neither room nor price, so they are derived before the fill joins. That keeps
    the generated code in pieces that the JVM compiles.
    """
    features = engineer(df, rate)
    return tables.fill(features) if tables else features


@dataclass
class Preprocessor:
    """Fitted preprocessing: fill tables and the vector pipeline. The target is optional in use."""

    tables: impute.ImputationTables
    vectors: PipelineModel
    rate: float = USD_TO_SGD

    @classmethod
    def fit(cls, raw: DataFrame, roles: Roles = ROLES, rate: float = USD_TO_SGD) -> Preprocessor:
        """Learn from raw training bookings.

        Fitting reads its input several times, so the cleaned rows are stored, and so are the filled.
        """
        cleaned = stored(features_of(raw, None, rate), "cleaned")
        tables = impute.fit(cleaned)
        filled = stored(tables.fill(cleaned), "filled")
        return cls(tables, fit_vectors(filled, roles), rate)

    def features(self, raw: DataFrame) -> DataFrame:
        return features_of(raw, self.tables, self.rate)

    def transform(self, raw: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Raw bookings to ``features`` vectors, next to ``keep`` or all feature columns.

        The row count observed on the way tells listeners how many bookings were prepared. It also
        ends one generated method and starts the next: in one piece the code outgrows what the JVM
        compiles, and rows take three times as long.
        """
        features = self.features(raw).observe(f"prepared-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
        names = list(keep) if keep is not None else features.columns
        return self.vectors.transform(features).select(*names, FEATURES)

    def save(self, path: str) -> None:
        self.vectors.write().overwrite().save(f"{path}/vectors")
        self.tables.save(f"{path}/tables")

    @classmethod
    def load(cls, spark: SparkSession, path: str, rate: float = USD_TO_SGD) -> Preprocessor:
        return cls(impute.ImputationTables.load(spark, f"{path}/tables"), PipelineModel.load(f"{path}/vectors"), rate)


def preprocess_splits(
    train: DataFrame, validation: DataFrame, test: DataFrame, fitted: Preprocessor | None = None
) -> tuple[Preprocessor, DataFrame, DataFrame, DataFrame]:
    """Fit on train (unless given) and transform all three: key, target and vector."""
    fitted = fitted or Preprocessor.fit(train)
    keep = [ROLES.key, ROLES.target]
    return fitted, *[fitted.transform(part, keep) for part in (train, validation, test)]
