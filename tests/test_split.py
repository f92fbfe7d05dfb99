import hashlib
from math import ceil

from pyspark.sql import functions as F

from lodgewise.operators import split


def people(spark, sizes, partitions=3):
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "booking_id bigint, no_show int").repartition(partitions)


def test_split_sizes_follow_the_fractions(spark):
    df = people(spark, {0: 801, 1: 202})
    out = split.stratified_split(df).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in out}
    test = ceil(1003 * 0.15)
    val = ceil((1003 - test) * 0.15)
    assert sizes == {"test": test, "val": val, "train": 1003 - test - val}


def test_split_takes_rows_in_hash_order(spark):
    df = people(spark, {0: 120, 1: 80})
    got = {r["booking_id"]: r["split"] for r in split.stratified_split(df, seed=7).collect()}
    sizes = split.split_sizes({0: 120, 1: 80}, 0.15, 0.15)
    for label, ids in ((0, range(120)), (1, range(120, 200))):
        order = sorted(ids, key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
        n_test, n_val, _ = sizes[label]
        want = ["test"] * n_test + ["val"] * n_val + ["train"] * (len(order) - n_test - n_val)
        assert [got[i] for i in order] == want


def test_split_does_not_depend_on_partitions(spark):
    sizes = {0: 300, 1: 50}
    a, b = (sorted(split.stratified_split(people(spark, sizes, n)).collect()) for n in (1, 7))
    assert a == b


def test_rows_without_target_have_no_split(spark):
    df = people(spark, {0: 20, 1: 20}).unionByName(spark.createDataFrame([(99, None)], "booking_id bigint, no_show int"))
    out = split.stratified_split(df)
    assert out.count() == 41
    assert out.where("booking_id = 99").first()["split"] is None


def test_tiny_classes_and_empty_blocks(spark):
    out = split.stratified_split(people(spark, {0: 5, 1: 1})).collect()
    assert len(out) == 6 and all(r["split"] for r in out)
    assert split.kfold(people(spark, {0: 3}), 5).groupBy("fold").count().count() == 3


def test_folds_are_even_per_class(spark):
    out = split.kfold(people(spark, {0: 103, 1: 52}), 5).groupBy("no_show", "fold").count().collect()
    sizes = {(r["no_show"], r["fold"]): r["count"] for r in out}
    assert [sizes[0, f] for f in range(5)] == [21, 21, 21, 20, 20]
    assert [sizes[1, f] for f in range(5)] == [11, 11, 10, 10, 10]


def test_sample_is_exact_or_everything(spark):
    df = people(spark, {0: 70, 1: 30})
    assert split.sample_n(df, 33).count() == 33
    assert split.sample_n(df, 100).count() == 100
    assert split.sample_n(df, 1000).count() == 100


def test_class_weights(spark):
    out = split.class_weights(people(spark, {0: 75, 1: 25})).orderBy("no_show").collect()
    assert [(r["n"], r["balanced"], r["neg_over_pos"]) for r in out] == [(75, 100 / 150, 1.0), (25, 2.0, 3.0)]
    weighted = split.with_weights(people(spark, {0: 75, 1: 25}), "balanced")
    assert abs(weighted.agg(F.sum("weight")).first()[0] - 100) < 1e-9
