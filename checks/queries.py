"""The registered queries: every operator over whole tables.

The bookings table that the operators work on is derived from the given tables by Spark, and stored
in the shared folder once per session, as are its cleaned and its imputed form: queries that read
them prune columns and push filters into the scan, however often they read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from checks.oracle import DRIFT_CATEGORICAL, DRIFT_NUMERIC, EDA_CATEGORICAL, EDA_NUMERIC, SUMMARY_NUMERIC
from lodgewise.functions import clean, features
from lodgewise.operators import aggregates, drift, encode, evaluate, impute, profile, runs, split, stats
from lodgewise.plans import models, monitoring, scoring, training
from lodgewise.schema import BOOKING_COLUMNS, ROLES
from lodgewise.session import stored
from lodgewise.sources import tables
from lodgewise.sources.bookings import bookings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_frames: dict[tuple, object] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def _once(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _frames:
        _frames[key] = build()
    return _frames[key]


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that both engines agree on the last places."""
    return df.withColumns(
        {c: F.round(c, special.get(c, digits)) for c, t in df.dtypes if t == "double"}
    )


# frames


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "bookings", lambda: stored(bookings(spark, folder), "bookings"))


def known(spark: SparkSession, folder: str) -> DataFrame:
    return tables.canonical(raw(spark, folder))


def engineered(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "engineered", lambda: stored(features.engineer(known(spark, folder)), "engineered"))


def imputed(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "imputed", lambda: stored(impute.impute(engineered(spark, folder)), "imputed"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Three fixed rules score every booking; a stand-in for models that SQL can repeat."""
    df = engineered(spark, folder)
    rules = {
        "price_rule": F.least(F.coalesce("price", F.lit(0.0)) / 600000, F.lit(1.0)),
        "guest_rule": F.col("total_guests") / 8.0,
        "lead_rule": F.col("lead_time_months") / 11.0,
    }
    cells = [F.struct(F.lit(m).alias("model"), s.cast("double").alias("score")) for m, s in rules.items()]
    return df.select("booking_id", "booking_month", ROLES.target, F.inline(F.array(*cells))).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int")
    )


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bookings made in the first and in the second half of the year."""
    return df.where("booking_month <= 6"), df.where("booking_month > 6")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "metrics", lambda: stored(evaluate.all_metrics(scored(spark, folder)), "metrics"))


def half_metrics(spark: SparkSession, folder: str, newer: bool) -> DataFrame:
    part = halves(scored(spark, folder))[newer]
    return _once(spark, folder, f"metrics{newer}", lambda: stored(evaluate.all_metrics(part), "metrics"))


def vectors(spark: SparkSession, folder: str):
    return _once(spark, folder, "vectors", lambda: training.prepared(raw(spark, folder)))


# sources


@query("scan_noshow")
def _(spark, folder):
    tables.register(bookings(spark, folder))
    return tables.load(spark, f"SELECT {', '.join(BOOKING_COLUMNS)} FROM noshow WHERE no_show IS NOT NULL;")


def _adhoc(spark, folder, text):
    tables.register(raw(spark, folder))
    return tables.execute(spark, text)


@query("adhoc_sql_country")
def _(spark, folder):
    return rounded(
        _adhoc(spark, folder, "SELECT country, AVG(no_show) AS rate, COUNT(*) AS n FROM noshow GROUP BY country")
    )


@query("adhoc_sql_window")
def _(spark, folder):
    return _adhoc(
        spark,
        folder,
        """SELECT branch, platform, n, RANK() OVER (PARTITION BY branch ORDER BY n DESC) AS place
           FROM (SELECT branch, platform, COUNT(*) AS n FROM noshow GROUP BY branch, platform) AS t""",
    )


@query("adhoc_sql_having")
def _(spark, folder):
    return _adhoc(
        spark,
        folder,
        """SELECT room, first_time, SUM(no_show) AS lost FROM noshow WHERE room IS NOT NULL
           GROUP BY room, first_time HAVING COUNT(*) > 20""",
    )


@query("adhoc_sql_join")
def _(spark, folder):
    return rounded(
        _adhoc(
            spark,
            folder,
            """WITH per_country AS (SELECT country, AVG(no_show) AS rate FROM noshow GROUP BY country),
                    per_branch AS (SELECT branch, country, AVG(no_show) AS rate FROM noshow GROUP BY branch, country)
               SELECT b.branch, b.country, b.rate - c.rate AS above FROM per_branch b JOIN per_country c
               ON b.country = c.country""",
        )
    )


@query("adhoc_price_cast")
def _(spark, folder):
    return raw(spark, folder).select("booking_id", clean.sql_price(F.col("price")).alias("price_number"))


# cleaning: each rule straight on the scan


def _scan(spark, folder, **columns):
    return known(spark, folder).select("booking_id", *[c.alias(n) for n, c in columns.items()])


@query("clean_month")
def _(spark, folder):
    return _scan(
        spark, folder, **{m: clean.month(F.col(m)) for m in ("booking_month", "arrival_month", "checkout_month")}
    )


@query("clean_currency")
def _(spark, folder):
    return _scan(spark, folder, currency=clean.currency(F.col("price")))


@query("clean_price")
def _(spark, folder):
    return rounded(_scan(spark, folder, amount=clean.amount(F.col("price"))))


@query("convert_currency")
def _(spark, folder):
    out = clean.clean_bookings(known(spark, folder).select("booking_id", "price"))
    return rounded(out)


@query("clean_first_time")
def _(spark, folder):
    c = F.col("first_time")
    return _scan(spark, folder, flag=clean.flag(c), yes_no=clean.yes_no(c))


@query("clean_checkout_day")
def _(spark, folder):
    return _scan(spark, folder, checkout_day=F.abs("checkout_day"))


@query("clean_guest_counts")
def _(spark, folder):
    return _scan(spark, folder, **{c: clean.guests(F.col(c)) for c in ("num_adults", "num_children")})


@query("coerce_numeric")
def _(spark, folder):
    return _scan(spark, folder, num_adults=clean.to_number(F.col("num_adults")))


@query("drop_null_target")
def _(spark, folder):
    return raw(spark, folder).na.drop(subset=[ROLES.target]).select("booking_id", ROLES.target)


# features


def _cleaned(spark, folder):
    return clean.clean_bookings(known(spark, folder))


@query("days_in_month")
def _(spark, folder):
    days = {f"{m}_days": features.days_in_month(F.col(f"{m}_month")) for m in ("arrival", "checkout")}
    return _cleaned(spark, folder).select("booking_id", *[c.alias(n) for n, c in days.items()])


def _features(spark, folder, *columns):
    return rounded(features.engineer(known(spark, folder)).select("booking_id", *columns))


@query("stay_length")
def _(spark, folder):
    return _features(spark, folder, "stay_length")


@query("lead_time")
def _(spark, folder):
    return _features(spark, folder, "lead_time_months")


@query("guest_features")
def _(spark, folder):
    return _features(spark, folder, "total_guests", "price_per_guest")


@query("cyclical_month")
def _(spark, folder):
    return _features(spark, folder, *[f"{m}_month_{f}" for m in ("arrival", "booking") for f in ("sin", "cos")])


@query("cyclical_day")
def _(spark, folder):
    return _features(spark, folder, *[f"{m}_day_{f}" for m in ("arrival", "checkout") for f in ("sin", "cos")])


@query("engineer_features")
def _(spark, folder):
    return _features(
        spark, folder, ROLES.target, "branch", "country", "room", "platform", "currency", "first_time", *ROLES.numerical
    )


@query("inferred_month_days")
def _(spark, folder):
    return features.inferred_month_days(_cleaned(spark, folder))


# imputation


@query("room_mode_by_group")
def _(spark, folder):
    return impute.group_mode(features.engineer(known(spark, folder)), impute.ROOM_KEYS, "room")


@query("room_mode_by_branch")
def _(spark, folder):
    return impute.group_mode(known(spark, folder), ["branch"], "room")


@query("impute_room")
def _(spark, folder):
    return impute.impute_rooms(engineered(spark, folder)).select("booking_id", "room")


@query("impute_price")
def _(spark, folder):
    return rounded(impute.impute(engineered(spark, folder)).select("booking_id", "room", "price"))


@query("missing_indicator")
def _(spark, folder):
    df = impute.missing_indicators(known(spark, folder), ["room", "price"])
    return df.select("booking_id", "room_missing", "price_missing")


@query("imputation_summary")
def _(spark, folder):
    return impute.imputation_summary(engineered(spark, folder), imputed(spark, folder), ["room", "price"])


@query("imputation_shift")
def _(spark, folder):
    return rounded(impute.imputation_shift(engineered(spark, folder), imputed(spark, folder)), 4)


@query("median_impute")
def _(spark, folder):
    df = encode.median_impute(engineered(spark, folder), ["price", "price_per_guest"])
    return rounded(df.select("booking_id", "price", "price_per_guest"))


@query("constant_impute")
def _(spark, folder):
    return impute.fill_constant(known(spark, folder).select("booking_id", "branch", "room"), ["branch", "room"])


# encoding, splits


@query("standard_scale")
def _(spark, folder):
    df = imputed(spark, folder).select("booking_id", *ROLES.numerical)
    return rounded(encode.standard_scale(df, ROLES.numerical))


@query("one_hot")
def _(spark, folder):
    df = split.stratified_split(known(spark, folder))
    columns = ["branch", "country", "room", "platform", "booking_month", "arrival_month"]
    df = df.select("booking_id", "split", *[F.col(c).cast("string").alias(c) for c in columns])
    hot = encode.one_hot(df.where("split = 'train'"), df, columns)
    places = {c: F.array_position(vector_to_array(f"{c}__hot"), F.lit(1.0)) for c in columns}
    sums = {c: F.aggregate(vector_to_array(f"{c}__hot"), F.lit(0.0), lambda a, x: a + x) for c in columns}
    return hot.select(
        "booking_id",
        *[p.alias(f"{c}_slot") for c, p in places.items()],
        sum(sums.values()).cast("int").alias("ones"),
    )


@query("assemble_features")
def _(spark, folder):
    df = imputed(spark, folder)
    out = encode.fit_vectors(df).transform(df)
    arr = vector_to_array(encode.FEATURES)
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return out.select("booking_id", F.size(arr).alias("slots"), F.round(total, 5).alias("total"))


@query("preprocess_splits")
def _(spark, folder):
    _, *parts = vectors(spark, folder)
    out = [
        p.groupBy(F.lit(n).alias("split"), ROLES.target).agg(
            F.count("*").alias("n"), F.max(F.size(vector_to_array(encode.FEATURES))).alias("slots")
        )
        for n, p in zip(("train", "val", "test"), parts)
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("stratified_split")
def _(spark, folder):
    return split.stratified_split(known(spark, folder)).select("booking_id", "no_show", "split")


@query("sample_n")
def _(spark, folder):
    return split.sample_n(known(spark, folder), 5000).select("booking_id", "no_show")


@query("kfold_assign")
def _(spark, folder):
    return split.kfold(known(spark, folder)).select("booking_id", "no_show", "fold")


@query("class_weights")
def _(spark, folder):
    return rounded(split.class_weights(known(spark, folder)))


# aggregates


@query("dashboard_kpis")
def _(spark, folder):
    return rounded(aggregates.kpis(_cleaned(spark, folder)), avg_price=4, revenue_at_risk=0)


@query("rate_by_platform")
def _(spark, folder):
    return rounded(aggregates.rate_by(known(spark, folder), "platform"))


@query("rate_by_room")
def _(spark, folder):
    return rounded(aggregates.rate_by(known(spark, folder), "room"))


@query("rate_by_first_time")
def _(spark, folder):
    df = known(spark, folder).withColumn("first_time", clean.yes_no(F.col("first_time")))
    return rounded(aggregates.rate_by_first_time(df))


@query("price_histogram")
def _(spark, folder):
    return rounded(aggregates.price_histogram(engineered(spark, folder)), 4)


@query("numeric_histogram")
def _(spark, folder):
    return rounded(aggregates.histogram(engineered(spark, folder), EDA_NUMERIC, 50), 4)


@query("numeric_stats")
def _(spark, folder):
    return rounded(aggregates.numeric_stats(engineered(spark, folder), EDA_NUMERIC), 4)


@query("value_counts")
def _(spark, folder):
    return aggregates.value_counts(known(spark, folder), "room", with_null=True)


@query("value_counts_top")
def _(spark, folder):
    return aggregates.value_counts(known(spark, folder), "country", top=10)


@query("rate_by_column")
def _(spark, folder):
    return rounded(aggregates.rates(_cleaned(spark, folder), EDA_CATEGORICAL))


@query("rate_by_quantile")
def _(spark, folder):
    return rounded(aggregates.rate_by_quantile(imputed(spark, folder), EDA_NUMERIC), 4, no_show_pct=6)


@query("crosstab")
def _(spark, folder):
    return aggregates.crosstab(known(spark, folder), "platform", "no_show")


@query("crosstab_wide")
def _(spark, folder):
    out = aggregates.crosstab_wide(known(spark, folder), "platform", "no_show", [0, 1])
    return out.toDF("platform", "shows", "no_shows")


@query("missingness_rate")
def _(spark, folder):
    return rounded(aggregates.missingness_rates(known(spark, folder), ["room", "price"]))


@query("missingness_shift")
def _(spark, folder):
    return rounded(aggregates.missingness_shift(_cleaned(spark, folder), "price", ["arrival_day", "checkout_day"]))


# profile


@query("column_summary")
def _(spark, folder):
    return profile.column_summary(raw(spark, folder))


@query("missing_report")
def _(spark, folder):
    return profile.missing_report(raw(spark, folder))


@query("duplicate_count")
def _(spark, folder):
    rows = raw(spark, folder)
    return profile.duplicate_count(rows.unionByName(rows.where("branch = 'Changi'")))


@query("null_target_count")
def _(spark, folder):
    return profile.null_target_count(raw(spark, folder))


@query("distinct_values")
def _(spark, folder):
    return profile.distinct_values(known(spark, folder), "arrival_month")


@query("negative_counts")
def _(spark, folder):
    return profile.negative_counts(known(spark, folder), ["arrival_day", "checkout_day", "num_children"])


@query("non_numeric_report")
def _(spark, folder):
    return rounded(profile.non_numeric_report(known(spark, folder), ["num_adults", "num_children"]))


@query("non_numeric_values")
def _(spark, folder):
    return profile.non_numeric_values(known(spark, folder), ["num_adults", "num_children"])


@query("guest_validity")
def _(spark, folder):
    return profile.guest_validity(_cleaned(spark, folder))


@query("iqr_outliers")
def _(spark, folder):
    columns = [*EDA_NUMERIC, "stay_length", "price_per_guest"]
    return rounded(profile.iqr_outliers(engineered(spark, folder), columns), 4)


# statistics


@query("pearson_matrix")
def _(spark, folder):
    return rounded(stats.pearson_matrix(imputed(spark, folder), EDA_NUMERIC))


@query("high_corr_pairs")
def _(spark, folder):
    return rounded(stats.high_corr_pairs(imputed(spark, folder), EDA_NUMERIC))


@query("point_biserial")
def _(spark, folder):
    return rounded(stats.point_biserial(imputed(spark, folder), EDA_NUMERIC))


@query("chi_square")
def _(spark, folder):
    return rounded(stats.chi_square(imputed(spark, folder), EDA_CATEGORICAL), chi2=4)


@query("significant_features")
def _(spark, folder):
    tests = stats.chi_square(imputed(spark, folder), EDA_CATEGORICAL)
    return stats.significant_features(tests).select("feature")


@query("cramers_v_matrix")
def _(spark, folder):
    return rounded(stats.cramers_v_matrix(imputed(spark, folder), EDA_CATEGORICAL))


@query("high_assoc_pairs")
def _(spark, folder):
    return rounded(stats.high_assoc_pairs(imputed(spark, folder), EDA_CATEGORICAL, 0.02))


@query("vif")
def _(spark, folder):
    return rounded(stats.vif(imputed(spark, folder), EDA_NUMERIC), 5)


@query("vif_collinear")
def _(spark, folder):
    return rounded(stats.vif(imputed(spark, folder), EDA_NUMERIC).where("flagged"), 5)


@query("feature_ranking")
def _(spark, folder):
    ranked = stats.feature_ranking(imputed(spark, folder), EDA_NUMERIC, EDA_CATEGORICAL)
    return rounded(ranked, vif=5)


# evaluation


@query("confusion_matrix")
def _(spark, folder):
    return evaluate.confusion_matrix(scored(spark, folder))


@query("classification_metrics")
def _(spark, folder):
    return rounded(evaluate.classification_metrics(scored(spark, folder)))


@query("roc_auc")
def _(spark, folder):
    return rounded(evaluate.roc_auc(scored(spark, folder)))


@query("average_precision")
def _(spark, folder):
    return rounded(evaluate.average_precision(scored(spark, folder)))


@query("compare_models")
def _(spark, folder):
    return rounded(evaluate.compare_models(evaluate.metrics_long(metrics(spark, folder))))


@query("metrics_long")
def _(spark, folder):
    return rounded(evaluate.metrics_long(evaluate.all_metrics(scored(spark, folder))))


@query("champion")
def _(spark, folder):
    return rounded(evaluate.champion(metrics(spark, folder)))


@query("best_per_metric")
def _(spark, folder):
    return rounded(evaluate.best_per_metric(evaluate.metrics_long(metrics(spark, folder))))


@query("promote_champion")
def _(spark, folder):
    older, newer = (evaluate.champion(half_metrics(spark, folder, n)) for n in (False, True))
    return rounded(evaluate.promote(older, newer))


@query("threshold_check")
def _(spark, folder):
    return rounded(evaluate.threshold_check(evaluate.metrics_long(metrics(spark, folder)), {"recall": 0.3}))


@query("degradation_check")
def _(spark, folder):
    older, newer = (evaluate.metrics_long(half_metrics(spark, folder, n)) for n in (False, True))
    return rounded(evaluate.degradation_check(newer, older))


@query("class_report")
def _(spark, folder):
    return rounded(evaluate.class_report(scored(spark, folder)))


# drift


def _halves(spark, folder):
    return halves(imputed(spark, folder))


@query("drift_ks")
def _(spark, folder):
    return rounded(drift.ks(*_halves(spark, folder), DRIFT_NUMERIC))


@query("drift_wasserstein")
def _(spark, folder):
    return rounded(drift.wasserstein(*_halves(spark, folder), DRIFT_NUMERIC), statistic=3)


@query("drift_chi2")
def _(spark, folder):
    return rounded(drift.chi2(*_halves(spark, folder), DRIFT_CATEGORICAL), statistic=4)


@query("drift_js")
def _(spark, folder):
    return rounded(drift.jensen_shannon(*_halves(spark, folder), DRIFT_CATEGORICAL))


@query("drift_z")
def _(spark, folder):
    return rounded(drift.z_proportion(*_halves(spark, folder), ["branch", "first_time"]))


# small counts of people are compared as categories
DRIFT_COUNTS = ["num_adults", "num_children"]
DRIFT_MEASURES = [c for c in DRIFT_NUMERIC if c not in DRIFT_COUNTS]


@query("drift_columns")
def _(spark, folder):
    columns, _ = monitoring.monitor_drift(*_halves(spark, folder), DRIFT_MEASURES, [*DRIFT_CATEGORICAL, *DRIFT_COUNTS])
    return rounded(columns.select("column", "method", "score", "drifted"))


@query("drift_summary")
def _(spark, folder):
    _, summary = monitoring.monitor_drift(*_halves(spark, folder), DRIFT_MEASURES, [*DRIFT_CATEGORICAL, *DRIFT_COUNTS])
    return rounded(summary)


@query("data_summary")
def _(spark, folder):
    older, newer = halves(engineered(spark, folder))
    frames = {"reference": older, "current": newer}
    return rounded(drift.data_summary(frames, SUMMARY_NUMERIC, EDA_CATEGORICAL), 3)


# models: the published parameters, spaces, trials and folds

#: Whole as well, but longer than a check may take; see README for what was measured.
LONG_QUERIES: dict[str, Query] = {}


def trained(spark, folder, name) -> training.Trained:
    """One fit with the published parameters and its validation metrics; `cv_summary` is the cross-validation."""

    def build():
        _, train, val, _ = vectors(spark, folder)
        return training.train(name, train, val, folds=0)

    return _once(spark, folder, f"model_{name}", build)


def _model_query(name):
    return lambda spark, folder: training.results_long(spark, [trained(spark, folder, name)])


def _tune_query(name):
    def run(spark, folder):
        _, train, _, _ = vectors(spark, folder)
        _, _, table = training.tune(name, train)
        return table.select("trial", "cv_roc_auc_mean", "cv_roc_auc_std", F.to_json("params").alias("params"))

    return run


QUERIES["model_random_forest"] = _model_query("random_forest")
for _key, _name in (("model_gbt", "xgboost"), ("model_mlp", "neural_network"), ("model_gbt_balanced", "lightgbm")):
    LONG_QUERIES[_key] = _model_query(_name)
for _name in models.BUILDERS:
    LONG_QUERIES[f"tune_{_name}"] = _tune_query(_name)


@query("cv_summary")
def _(spark, folder):
    _, train, _, _ = vectors(spark, folder)
    mean, std = training.cross_validate("random_forest", models.defaults("random_forest"), train)
    return spark.createDataFrame([("random_forest", mean, std)], "model string, cv_roc_auc_mean double, cv_roc_auc_std double")


def _scored_batch(spark, folder):
    fitted, *_ = vectors(spark, folder)
    return scoring.score(raw(spark, folder), fitted, trained(spark, folder, "random_forest").model)


@query("score_batch")
def _(spark, folder):
    return _scored_batch(spark, folder)


@query("score_batch_facts")
def _(spark, folder):
    p = F.col("noshow_prob")
    facts = {"in_range": p.between(0, 1), "prediction_follows": F.col("prediction") == (p > 0.5).cast("int")}
    facts[ROLES.target] = F.col(ROLES.target).cast("string")
    return _scored_batch(spark, folder).withColumns(facts).drop("noshow_prob", "prediction")


@query("importance_facts")
def _(spark, folder):
    table = trained(spark, folder, "random_forest").importance
    return table.agg(
        F.round(F.sum("importance"), 6).alias("total"),
        F.count_if(F.col("importance") < 0).alias("negative"),
        (F.count("*") - F.count_distinct("feature")).alias("repeated"),
    )


@query("score_summary")
def _(spark, folder):
    return scoring.score_summary(_scored_batch(spark, folder))


@query("risk_band")
def _(spark, folder):
    return scored(spark, folder).select("booking_id", "model", scoring.risk_band(F.col("score")).alias("risk"))


@query("feature_importance")
def _(spark, folder):
    return trained(spark, folder, "random_forest").importance


@query("top_importance")
def _(spark, folder):
    return training.top_importance(trained(spark, folder, "random_forest").importance, 15)


# experiment tables


def experiment(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Runs and metrics of the three rules: one parent, one child per rule."""
    wide = metrics(spark, folder)
    child = wide.select(
        F.concat(F.lit("run-"), "model").alias("run_id"), F.lit("experiment").alias("parent_run_id"), F.col("model").alias("name")
    )
    parent = wide.agg(F.count("*").alias("n")).select(
        F.lit("experiment").alias("run_id"), F.lit(None).cast("string").alias("parent_run_id"), F.lit("comparison").alias("name")
    )
    rows = runs.metric_rows(wide.withColumn("run_id", F.concat(F.lit("run-"), "model")))
    return parent.unionByName(child), rows


def _data_stats(spark, folder):
    df = split.stratified_split(known(spark, folder))
    return runs.run_data_stats(df, len(ROLES.features))


@query("log_params")
def _(spark, folder):
    nested = _data_stats(spark, folder).withColumn("run_id", F.lit("experiment"))
    nested = nested.withColumn(
        "data",
        F.col("data")
        .withField("train_positive_rate", F.round("data.train_positive_rate", 6))
        .withField("val_positive_rate", F.round("data.val_positive_rate", 6)),
    )
    return runs.param_rows(nested)


@query("log_metrics")
def _(spark, folder):
    wide = metrics(spark, folder).withColumn("run_id", F.concat(F.lit("run-"), "model"))
    return rounded(runs.metric_rows(wide, prefix="final_"))


@query("run_tree")
def _(spark, folder):
    return runs.run_tree(experiment(spark, folder)[0])


@query("search_runs")
def _(spark, folder):
    return rounded(runs.search_runs(*experiment(spark, folder), where="roc_auc > 0.45 and parent_run_id = 'experiment'"))


@query("run_data_stats")
def _(spark, folder):
    return rounded(_data_stats(spark, folder).select("data.*"))


@query("experiment_summary")
def _(spark, folder):
    return rounded(runs.experiment_summary(metrics(spark, folder)))


@query("comparison_metrics")
def _(spark, folder):
    return rounded(runs.comparison_metrics(evaluate.metrics_long(metrics(spark, folder))))
