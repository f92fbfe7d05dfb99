"""The queries and the pipeline on the driver's tables."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from lodgewise.llm import jaccard_join, toxicity
from lodgewise.llm.common import table

FOLDER, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")


def test_one_query_for_each_operator():
    names = [n for n in driver.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in driver.queries()


def test_toxicity_on_held_out_rows(spark):
    # the smaller tables have six toxic rows held out, of which labels that fit no text are too large a part
    got = driver.queries()["op7_toxicity"](spark, LARGE).toPandas()
    known = table(spark, LARGE, "labels").select("doc_id", "toxic").dropna().toPandas().merge(got, on="doc_id")
    held = known[known["held_out"]]
    ranks = held["score"].rank()
    p = (held["toxic"] == 1).sum()
    auc = (ranks[held["toxic"] == 1].sum() - p * (p + 1) / 2) / (p * (len(held) - p))
    accuracy = (held["predicted"] == held["toxic"]).mean()
    assert len(got) == table(spark, LARGE, "documents").count() and got["score"].between(0, 1).all()
    assert auc >= 0.9 and accuracy >= 0.9


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, seen = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    before = seen
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        now = [r[0] for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) < before, name
        before = set(now)
    mixed = corpus_pipeline.mixed(spark, docs, FOLDER).cache()
    assert mixed.columns == columns and {r[0] for r in mixed.select("doc_id").collect()} <= before
    rows = corpus_pipeline.packed(spark, mixed, FOLDER)
    pieces = rows.select(F.explode(F.arrays_zip("doc_ids", "pieces")).alias("x")).filter("x.pieces = 0").select("x.doc_ids")
    assert sorted(r[0] for r in pieces.collect()) == sorted(r[0] for r in mixed.select("doc_id").collect())
    # nothing is left for the stages to do
    twice = jaccard_join.representatives(docs)
    assert twice.count() == docs.count()
    model = toxicity.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    assert toxicity.keep(docs, model).count() == docs.count()


@pytest.mark.parametrize("name", ["mixing", "packing"])
def test_stages_hand_over_small_batches(spark, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.createDataFrame([(1, "a b c", "en", "web", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER).count() >= 1

        def sizes(batches):
            for batch in batches:
                yield pa.record_batch([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

        long = spark.range(0, 3_000, 1, 1).select(F.repeat(F.lit("word "), 2_000).alias("text"))
        got = long.mapInArrow(sizes, "size bigint, n bigint").collect()
        assert sum(r["n"] for r in got) == 3_000
        assert max(r["size"] for r in got) < 1.1 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_shuffles_of_a_stage_go_with_its_queries(spark):
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size()))
        return {n for n in names if n.startswith("shuffle_")}

    there = []

    def stage(spark, docs, sf_dir):
        there.append(shuffled())
        docs.groupBy("id").count().write.format("noop").mode("overwrite").save()
        there.append(shuffled())
        return docs

    try:
        corpus_pipeline.in_small_batches(stage)(spark, spark.range(0, 1_000, 1, 4).repartition(3), FOLDER)
        assert there[1] <= there[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
