import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lodgewise.plans import training
from lodgewise.plans.boosting import Boosted, BoostedClassifier, bin_cuts


def table(spark, n, seed=1, parts=3):
    """Three slots: many values, few values, and one that says nothing. Weights from 1 to 3."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 2), float(rng.randint(0, 4)), rng.random()
        y = int(rng.random() < 1 / (1 + np.exp(-(a * (1 if b > 2 else -1) + b - 2))))
        rows.append((i, y, float(1 + i % 3), [a, b, c]))
    df = spark.createDataFrame(rows, "booking_id long, no_show int, weight double, v array<double>")
    return rows, df.withColumn("features", array_to_vector("v")).drop("v").repartition(parts)


def pull(g, alpha):
    return max(0.0, abs(g) - alpha) * (1 if g > 0 else -1)


def plain_tree(x, g, h, s):
    """Leaf by leaf: of all leaves and all thresholds between values the one of the largest gain, until there are enough leaves."""

    def score(rows):
        return pull(g[rows].sum(), s["reg_alpha"]) ** 2 / (h[rows].sum() + s["reg_lambda"])

    def best(rows):
        found = None
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for low, high in zip(values, values[1:]):
                left = x[rows, j] <= (low + high) / 2
                sides = rows[left], rows[~left]
                if min(map(len, sides)) < max(1, s["min_child_samples"]) or min(h[r].sum() for r in sides) < s["min_child_weight"]:
                    continue
                gain = (score(sides[0]) + score(sides[1]) - score(rows)) / 2 - s["gamma"]
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, *sides)
        return found

    leaves = [(np.arange(len(x)), 0, best(np.arange(len(x))))]
    while len(leaves) < s["num_leaves"]:
        open_ = [i for i, (_, depth, cut) in enumerate(leaves) if cut and depth < s["max_depth"]]
        if not open_:
            break
        _, depth, cut = leaves.pop(max(open_, key=lambda i: leaves[i][2][0]))
        leaves += [(side, depth + 1, best(side)) for side in cut[1:]]
    out = np.zeros(len(x))
    for rows, _, _ in leaves:
        out[rows] = -s["learning_rate"] * pull(g[rows].sum(), s["reg_alpha"]) / (h[rows].sum() + s["reg_lambda"])
    return out, len(leaves)


SETTINGS = {
    "learning_rate": 0.5,
    "max_depth": 6,
    "num_leaves": 9,
    "min_child_samples": 4,
    "min_child_weight": 2.0,
    "gamma": 0.3,
    "reg_alpha": 0.7,
    "reg_lambda": 1.5,
}


@pytest.mark.parametrize("changed", [{}, {"num_leaves": 40, "gamma": 0.0}, {"max_depth": 3}, {"reg_alpha": 0.0, "min_child_samples": 60}])
def test_trees_are_those_of_plain_python(spark, changed):
    settings = {**SETTINGS, **changed}
    rows, df = table(spark, 250)
    x, y, w = (np.array([r[k] for r in rows], float) for k in (3, 1, 2))
    estimator = BoostedClassifier({**settings, "n_estimators": 2})
    estimator.cells = 600  # two leaves a pass
    model = estimator.fit(df)
    share = (w * y).sum() / w.sum()
    margin = np.full(len(x), np.log(share / (1 - share)))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        step, leaves = plain_tree(x, (p - y) * w, p * (1 - p) * w, settings)
        assert (tree["left"] < 0).sum() == leaves
        margin += step
    found = {r["booking_id"]: r["p"] for r in training.scores(model, df, "m").withColumnRenamed("score", "p").collect()}
    assert np.abs(1 / (1 + np.exp(-margin)) - [found[i] for i in range(len(x))]).max() < 1e-6


def test_cuts_are_between_all_values_or_at_quantiles(spark):
    rows, df = table(spark, 2_000)
    many, few, _ = bin_cuts(df, "features", 16)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5]
    held = np.bincount(np.searchsorted(many, [r[3][0] for r in rows]))
    assert len(many) == 15 and held.min() >= 124 and held.max() <= 126
    # one value that most rows have: it shares its bin with rarer values only, and those beyond it are cut at quantiles
    hot = df.withColumn("features", array_to_vector(F.array(F.when(F.col("booking_id") % 10 > 0, 5.0).otherwise(F.col("booking_id").cast("double")))))
    (cuts,) = bin_cuts(hot, "features", 16)
    assert cuts.tolist() == [7.5, 745.0]  # 180 of the values are above 9 tenths of the rows, so the bins end at 15 and 16 of 16


def test_tasks_and_their_order_change_nothing(spark):
    _, df = table(spark, 1_200)
    settings = {**SETTINGS, "n_estimators": 3, "subsample": 0.6, "colsample_bytree": 0.7}
    one, other = (BoostedClassifier(settings).fit(df.repartition(n)) for n in (1, 7))
    assert [t for _, t in one.payloads()] == [t for _, t in other.payloads()]
    assert len({tuple(t["slot"][t["left"] >= 0]) for t in one.trees}) > 1


def test_stopped_fit_goes_on_after_its_last_commit(spark, tmp_path, monkeypatch):
    _, df = table(spark, 400)
    settings = {**SETTINGS, "n_estimators": 7, "subsample": 0.8}
    real, rounds = BoostedClassifier._round, []

    def build():
        estimator = BoostedClassifier(settings).restartable(str(tmp_path / "fit"), training.data_id(df))
        estimator.kept = 2
        return estimator

    def failing(self, rows, model, since, number, head):
        rounds.append(number)
        if len(rounds) == 6:
            raise RuntimeError("stopped")
        return real(self, rows, model, since, number, head)

    monkeypatch.setattr(BoostedClassifier, "_round", failing)
    with pytest.raises(RuntimeError, match="stopped"):
        build().fit(df)
    model = build().fit(df)
    assert rounds == [0, 1, 2, 3, 4, 5, 4, 5, 6]
    whole = BoostedClassifier(settings)
    whole.kept = 2
    assert model.payloads() == whole.fit(df).payloads()
    build().fit(df)
    assert len(rounds) == 9 + 7  # the finished fit is read


def test_saved_trees_score_alike(spark, tmp_path):
    _, df = table(spark, 300)
    model = BoostedClassifier({**SETTINGS, "n_estimators": 2}).fit(df)
    training.save_model(model, str(tmp_path / "model"))
    again = training.load_model(str(tmp_path / "model"))
    assert isinstance(again, Boosted) and again.payloads() == model.payloads()
    assert sorted(training.scores(again, df, "m").collect()) == sorted(training.scores(model, df, "m").collect())
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9
    assert model.featureImportances[0] > model.featureImportances[2]


def test_odd_rows(spark):
    _, df = table(spark, 60)
    settings = {"n_estimators": 1, "max_depth": 2}
    with pytest.raises(ValueError, match="no weighed rows"):
        BoostedClassifier(settings).fit(df.limit(0))
    # rows without a label, and a table of one class, whose trees are single leaves
    gaps = df.withColumn("no_show", F.when(F.col("booking_id") % 2 == 0, F.lit(1)))
    model = BoostedClassifier(settings).fit(gaps)
    low, high = training.scores(model, df, "m").agg(F.min("score"), F.max("score")).first()
    assert 0.999 < low <= high <= 1
    # NaN goes with the largest values, no vector gives no score
    nan = df.withColumn("features", F.when(F.col("booking_id") > 0, array_to_vector(F.array(F.lit(float("nan")), F.lit(1.0), F.lit(0.5)))))
    told = {r["booking_id"]: r["probability"] for r in model.transform(nan).select("booking_id", "probability").collect()}
    assert told[0] is None and told[1][1] > 0.999
