import pytest
from pyspark.sql import DataFrame

from lodgewise.operators import aggregates, profile, runs
from lodgewise.sources import tables


def test_queries_run_and_bad_ones_are_reported(spark, clean_bookings):
    tables.register(clean_bookings)
    out = tables.execute(spark, "SELECT branch, AVG(no_show) AS r FROM noshow GROUP BY branch;")
    assert isinstance(out, DataFrame) and out.count() == 3
    assert tables.execute(spark).count() == 100
    assert "error" in tables.execute(spark, "SELECT nothing FROM noshow")
    assert "error" in tables.execute(spark, "SELEC 1")


def test_preview(clean_bookings):
    out = tables.preview(clean_bookings.select("branch", "room"), 5)
    assert (out["rows"], out["columns"], out["names"], len(out["head"])) == (640, 2, ["branch", "room"], 5)


def test_csv_parquet_and_json_round_trips(spark, clean_bookings, tmp_path):
    schema = clean_bookings.schema
    clean_bookings.write.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(tables.read_csv(spark, str(tmp_path / "csv"), schema).collect()) == sorted(clean_bookings.collect())
    tables.write_parquet(clean_bookings, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 640
    tables.write_json(clean_bookings, str(tmp_path / "js"))
    assert spark.read.schema(schema).json(str(tmp_path / "js")).count() == 640


def test_csv_goes_by_column_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("no_show,extra,booking_id\n1,x,77\n0,y,many\n")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "booking_id bigint, no_show int")
    assert got.columns == ["booking_id", "no_show", "extra"]
    assert [tuple(r) for r in got.collect()] == [(77, 1, "x"), (None, 0, "y")]
    with pytest.raises(ValueError, match="price"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), "booking_id bigint, price double")


def test_canonical_and_roles(clean_bookings):
    df = clean_bookings.selectExpr("*", "CASE WHEN booking_id >= 7010 THEN no_show END AS t").drop("no_show").withColumnRenamed("t", "no_show")
    assert tables.canonical(df).count() == 630
    numeric, text = tables.infer_roles(clean_bookings, exclude=("booking_id",))
    assert text == ["platform", "branch", "room", "country"] and "price" in numeric and "no_show" not in numeric


def test_duplicates_and_missing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, None), (1, None)], "x int, y string")
    assert profile.duplicate_count(df).first() == (2, 40.0)
    assert profile.missing_report(df).collect() == [("y", 4, 80.0)]
    assert [tuple(r) for r in profile.column_summary(df).collect()] == [("x", "int", 5, 2), ("y", "string", 1, 1)]


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    out = aggregates.histogram(df, ["x"], 10).collect()
    assert [(r["n"], r["bin"]) for r in out] == [(4, 6)]


def test_quantile_bins_merge_equal_edges(spark):
    values = [0.0] * 61 + [float(i) for i in range(1, 40)]  # edges 0, 0, 0, 0, 19.2, 39
    df = spark.createDataFrame([(v, int(v > 20)) for v in values], "x double, no_show int")
    out = aggregates.rate_by_quantile(df, ["x"]).orderBy("bin").collect()
    assert sum(r["n"] for r in out) == 100
    assert [(r["bin"], r["n"]) for r in out] == [(1, 80), (2, 20)]
    assert (out[0]["lower"], out[1]["upper"]) == (0.0, 39.0) and abs(out[0]["upper"] - 19.2) < 1e-9


def test_columns_of_few_values_are_grouped_by_value(spark):
    df = spark.createDataFrame([(float(i % 3), i % 2) for i in range(12)] + [(None, 1)], "x double, no_show int")
    out = aggregates.rate_by_quantile(df, ["x"]).orderBy("bin").collect()
    assert [(r["bin"], r["lower"], r["upper"], r["no_show_pct"], r["n"]) for r in out] == [(i + 1, i, i, 50.0, 4) for i in range(3)]


def test_run_log(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path))
    parent = log.start("comparison", tags={"n_models": 2})
    child = log.start("forest", parent)
    log.log_params(child, {"model": {"depth": 3, "inner": {"a": "b"}}, "seed": 42})
    log.log_metrics(child, {"roc_auc": 0.7, "name": "ignored", "f1_score": 1}, prefix="")
    params = {r["key"]: r["value"] for r in log.table("params").collect()}
    assert params == {"model.depth": "3", "model.inner.a": "b", "seed": "42"}
    assert {r["metric"] for r in log.table("metrics").collect()} == {"roc_auc", "f1_score"}
    tree = {r["name"]: (r["parent_name"], r["children"]) for r in runs.run_tree(log.table("runs")).collect()}
    assert tree == {"comparison": (None, 1), "forest": ("comparison", 0)}
    assert log.search("roc_auc > 0.6").first()["name"] == "forest"


def test_nested_rows_flatten(spark):
    df = spark.sql("SELECT 'r' AS run_id, named_struct('a', 1, 'b', named_struct('c', 'x')) AS p, 2.5D AS q")
    assert {(r["key"], r["value"]) for r in runs.param_rows(df).collect()} == {("p.a", "1"), ("p.b.c", "x"), ("q", "2.5")}
    assert {(r["metric"], r["value"]) for r in runs.metric_rows(df, prefix="t_").collect()} == {("t_p.a", 1.0), ("t_q", 2.5)}


def test_answers_tell_errors_of_every_stage(spark):
    assert tables.answer(spark, "SELECT id FROM range(7);", 2) == {"rows": 7, "columns": 1, "names": ["id"], "head": [{"id": 0}, {"id": 1}]}
    for query in ("SELEC 1", "SELECT nothing FROM nowhere", "SELECT raise_error('stop') FROM range(3)", "SELECT 1 div (id - id) FROM range(3)"):
        assert list(tables.answer(spark, query)) == ["error"], query
