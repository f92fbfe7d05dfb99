import json

from lodgewise.__main__ import main


def metrics(path, **values):
    path.mkdir()
    rows = [json.dumps({"model": "m", "metric": k, "value": v}) for k, v in values.items()]
    (path / "part.json").write_text("\n".join(rows))
    return str(path)


def test_check_gates_and_alerts(spark, tmp_path):
    good = metrics(tmp_path / "good", roc_auc=0.8, f1_score=0.7, precision=0.7, recall=0.7)
    bad = metrics(tmp_path / "bad", roc_auc=0.6)
    was = metrics(tmp_path / "was", roc_auc=0.9, f1=0.7)
    assert main(["check", "--metrics", good], spark) == 0
    assert main(["check", "--metrics", bad], spark) == 1
    assert main(["check", "--metrics", good, "--baseline", was], spark) == 0
    assert main(["check", "--metrics", good, "--baseline", was, "--alert-on-degradation"], spark) == 1
    assert main(["check", "--metrics", good, "--baseline", was, "--threshold", "0.2", "--alert-on-degradation"], spark) == 0


def test_drift_job(spark, clean_bookings, tmp_path):
    paths = {}
    for name, where in (("a", "price < 300"), ("b", "price >= 300")):
        paths[name] = str(tmp_path / name)
        clean_bookings.where(where).write.parquet(paths[name])
    same = ["drift", "--reference", paths["a"], "--current", paths["a"], "--output", str(tmp_path / "same")]
    assert main(same, spark) == 0
    assert main([*same[:4], paths["b"], "--output", str(tmp_path / "other")], spark) == 0  # one column of many drifts
    assert spark.read.json(str(tmp_path / "other/columns")).where("drifted").where("column = 'price'").count() == 1
