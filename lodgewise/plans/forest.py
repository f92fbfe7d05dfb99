"""Random forests in parts: a few trees a fit, several fits at once, finished parts kept.

A forest of many deep trees in one fit sends ever larger tree sets to the executors and loses all of them if it is stopped.
Here it is fitted as sub-forests with seeds of their own. Bagging and feature draws are independent from tree to tree, so the
parts joined are a forest of all their trees: probabilities and importances are averages weighted by trees.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from math import ceil

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgewise.plans.boosting import Boosted
from lodgewise.session import exists, shared_folder

PART_TREES = 40
PARALLEL_PARTS = 8
TASK_ROWS = 200_000  # each task writes the histograms of every node its rows are in to the shuffle, so tasks have many rows
NODE_MEMORY_MB = 1_024  # histograms of one node group
_DONE = "fingerprint string, part int, trees int"


class Forest:
    """A fitted forest of parts; it scores, names importances and is saved like one model."""

    def __init__(self, parts: Sequence[RandomForestClassificationModel]):
        self.parts = list(parts)
        for i, part in enumerate(self.parts):
            part.setProbabilityCol(f"_part_{i}").setRawPredictionCol("").setPredictionCol("")

    @property
    def trees(self) -> int:
        return sum(p.getNumTrees for p in self.parts)

    @property
    def featureImportances(self) -> DenseVector:
        shares = sum(p.featureImportances.toArray() * p.getNumTrees for p in self.parts)
        return Vectors.dense(shares / max(shares.sum(), np.finfo(float).tiny))

    def transform(self, vectors: DataFrame) -> DataFrame:
        """The rows with ``probability`` and ``prediction``; equal votes predict class 0."""
        columns, out = vectors.columns, vectors
        for part in self.parts:
            out = part.transform(out)
        votes = sum(vector_to_array(f"_part_{i}")[1] * p.getNumTrees for i, p in enumerate(self.parts))
        one = F.least(votes / self.trees, F.lit(1.0))
        return out.withColumn("_one", one).select(
            *columns,
            array_to_vector(F.array(1 - F.col("_one"), F.col("_one"))).alias("probability"),
            (F.col("_one") > 0.5).cast("double").alias("prediction"),
        )

    def stages(self) -> list[RandomForestClassificationModel]:
        return self.parts


class ForestClassifier(RandomForestClassifier):
    """A random forest whose fit can be stopped and taken up again.

    With a ``folder`` each finished part is saved there and entered in a table; a later fit with the same parameters and
    ``data_id`` reads what is there and fits the rest.
    """

    part_trees = PART_TREES
    parallel = PARALLEL_PARTS
    folder: str | None = None
    data_id = ""

    def restartable(self, folder: str, data_id: str, part_trees: int = PART_TREES) -> ForestClassifier:
        self.folder, self.data_id, self.part_trees = folder.rstrip("/"), data_id, part_trees
        return self

    def fingerprint(self) -> str:
        values = {p.name: v for p, v in self.extractParamMap().items()}
        return json.dumps([self.data_id, self.part_trees, sorted(values.items(), key=lambda x: x[0])], default=str)

    def _part(self, rows: DataFrame, part: int, trees: int) -> RandomForestClassificationModel:
        plain = RandomForestClassifier()
        self._copyValues(plain)
        plain.setNumTrees(trees).setSeed(self.getSeed() + part).setMaxMemoryInMB(NODE_MEMORY_MB)
        return plain.setCacheNodeIds(True).fit(rows)  # rows keep their nodes: no pass sends the trees or walks them from the root

    def _finished(self, rows: DataFrame) -> set[int]:
        if self.folder is None:
            return set()
        try:
            done = rows.sparkSession.read.schema(_DONE).parquet(f"{self.folder}/done")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return set()
        return {r["part"] for r in done.where(F.col("fingerprint") == self.fingerprint()).collect()}

    def _fit(self, dataset: DataFrame) -> Forest:
        spark = dataset.sparkSession
        if spark.sparkContext.getCheckpointDir() is None:  # the kept nodes are checkpointed there every few passes
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        columns = [self.getFeaturesCol(), self.getLabelCol(), *([self.getWeightCol()] if self.isSet("weightCol") else [])]
        rows = dataset.select(*columns)
        tasks = max(1, ceil(rows.count() / TASK_ROWS))
        rows = rows.coalesce(tasks)
        total = self.getNumTrees()
        sizes = [min(self.part_trees, total - start) for start in range(0, total, self.part_trees)]
        done = self._finished(rows)
        path = f"{self.folder}/{zlib.crc32(self.fingerprint().encode()):08x}"
        parts: dict[int, RandomForestClassificationModel] = {
            i: RandomForestClassificationModel.load(f"{path}/part-{i}") for i in sorted(done) if i < len(sizes)
        }
        with ThreadPoolExecutor(self.parallel) as pool:
            running = {pool.submit(self._part, rows, i, n): i for i, n in enumerate(sizes) if i not in parts}
            try:
                for future in as_completed(running):
                    i = running[future]
                    parts[i] = future.result()
                    if self.folder is not None:  # one thread writes, so the table is appended to by one job at a time
                        parts[i].write().overwrite().save(f"{path}/part-{i}")
                        entry = spark.createDataFrame([(self.fingerprint(), i, sizes[i])], _DONE)
                        entry.coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
            except BaseException:
                for future in running:
                    future.cancel()
                raise
        return Forest([parts[i] for i in sorted(parts)])


def save(model, path: str) -> None:
    """A forest by its parts, boosted trees by their cuts and rounds, any other model as it is."""
    if isinstance(model, Boosted):
        model.save(path)
        return
    stages = model.stages() if isinstance(model, Forest) else [model]
    PipelineModel(stages).write().overwrite().save(path)


def load(path: str):
    spark = SparkSession.getActiveSession()
    if not exists(spark, f"{path}/metadata"):
        return Boosted.load(spark, path)
    stages = PipelineModel.load(path).stages
    return Forest(stages) if isinstance(stages[0], RandomForestClassificationModel) else stages[0]
