"""Gradient boosting over byte-binned features: trees grown best leaf first, finished rounds kept.

Features are cut once, at exact quantiles, into at most 255 bins a slot and stored as one byte each. A pass over the rows
sums gradients per (leaf, slot, bin) inside every task, so only these sums are shuffled. Running sums over the bins of a slot
give the best cut of each leaf, and one row a leaf reaches the driver. Gradients are summed as whole numbers: neither the order
of tasks nor one that runs again changes a tree.
"""

from __future__ import annotations

import heapq
import json
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from math import ceil, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodgewise.operators.order_stats import running_totals
from lodgewise.schema import ROLES, SEED
from lodgewise.session import exists, fresh_folder, remove

# the helpers travel with the query, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT_ROUNDS = 5  # margins are written, and rounds committed, so often
TASK_ROWS = 50_000
TASKS_PER_CORE = 4  # of a pass, at most: each task sends one set of sums
CELLS = 4_000_000  # sums of one kind that a task holds; more leaves than fit take further passes
SLICE_ROWS = 16_384
_COMMITS = "round int, payload string"
_SUMS = "node bigint, slot int, bin int, g bigint, h bigint, n bigint"


@dataclass(frozen=True)
class Settings:
    """The parameters of a fit, by the names users know. ``num_leaves`` 0 sets no limit but the depth."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    num_leaves: int = 0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    min_child_weight: float = 0.0
    min_child_samples: int = 1
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    max_bins: int = 255

    @classmethod
    def of(cls, params: dict) -> Settings:
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in params.items() if k in names})


@dataclass(frozen=True)
class Cut:
    """The best cut of a node: values in bins up to ``bin`` of ``slot`` go left. Sums are of the left side, then of the node."""

    gain: float
    slot: int
    bin: int
    left: tuple[int, int, int]
    whole: tuple[int, int, int]


def walk(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row of bins, by its number in the tree."""
    at = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins))
    while True:
        live = live[tree["left"][at[live]] >= 0]
        if not len(live):
            return at
        node = at[live]
        goes = bins[live, tree["slot"][node]] <= tree["bin"][node]
        at[live] = np.where(goes, tree["left"][node], tree["right"][node])


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bytes for the rows of a matrix: how many cuts of the slot are smaller. NaN goes with the largest values."""
    return np.stack([np.searchsorted(c, values[:, i], side="left") for i, c in enumerate(cuts)], 1).astype(np.uint8)


def drawn(ids: np.ndarray, mark: int, share: float) -> np.ndarray:
    """Which rows a round takes; it hangs on the row's id and the round alone."""
    if share >= 1:
        return np.ones(len(ids), bool)
    x = ids.view(np.uint64) ^ np.uint64(mark)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))) / 2.0**64 < share


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def byte_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def bin_cuts(rows: DataFrame, features: str, max_bins: int) -> list[np.ndarray]:
    """The cuts of each slot: between all neighbouring values where there are at most ``max_bins``, else at quantiles.

    A value that holds many quantiles takes as many bins' worth of rows, and rare values below it share its bin.

    Values and their numbers are summed before they move, running totals come from the library's tree of bounded windows,
    and at most ``max_bins`` cuts a slot reach the driver.
    """
    if not 2 <= max_bins <= 256:
        raise ValueError("a slot has 2 to 256 bins")
    slots = rows.select(F.posexplode(vector_to_array(features)).alias("slot", "value"))
    values = slots.groupBy("slot", "value").agg(F.count("*").alias("n")).withColumn("one", F.lit(1).cast("long"))
    totals = running_totals(values, ["slot"], "value", ["n", "one"])

    def share(n: Column) -> Column:
        return F.floor(n * F.lit(max_bins) / F.col("n_total"))

    ends = (F.col("one_total") <= max_bins) | (share(F.col("n_before") + F.col("n")) > share(F.col("n_before")))
    middle = F.col("value") / 2 + F.col("next_value") / 2
    inside = (middle >= F.col("value")) & (middle < F.col("next_value"))
    cut = F.when(inside, middle).otherwise(F.col("value"))
    found = totals.where(ends & F.col("next_value").isNotNull()).select("slot", cut.alias("cut")).collect()
    width = rows.select(F.max(F.size(vector_to_array(features)))).first()[0]
    return [np.array(sorted(r["cut"] for r in found if r["slot"] == i), float) for i in range(width)]


def grow(find: Callable[[dict[int, Cut], list[int]], dict[int, Cut | None]], leaves: int, depth: int) -> dict[int, Cut]:
    """The cuts of a tree of up to ``leaves`` leaves in which the leaf of the largest gain is always cut next.

    Nodes are numbered by their path: the root is 1, the children of k are 2k and 2k + 1. ``find`` looks for the best cuts of
    several nodes at once. The tree is played through with the cuts that are known; what turns out to be missing is looked for
    together, and the tree is played through again. So there are about as many passes as levels, not as leaves, and the tree
    is the one that asking leaf by leaf would give.
    """
    known: dict[int, Cut | None] = {}
    missing = [1] if depth > 0 and leaves > 1 else []
    chosen: dict[int, Cut] = {}
    while missing:
        known.update(find(chosen, missing))
        chosen, missing = {}, []
        queue = [(-known[1].gain, 1)] if known[1] else []
        while queue and len(chosen) < leaves - 1:
            _, node = heapq.heappop(queue)
            chosen[node] = known[node]
            for child in (2 * node, 2 * node + 1):
                if child.bit_length() > depth:
                    continue
                if child not in known:
                    missing.append(child)
                elif known[child]:
                    heapq.heappush(queue, (-known[child].gain, child))
    return chosen


def sums_of(node: int, chosen: dict[int, Cut], whole: tuple[int, int, int]) -> tuple[int, int, int]:
    """Gradients, second derivatives and rows of a node of the tree."""
    if node == 1:
        return whole
    parent = chosen[node // 2]
    return parent.left if node % 2 == 0 else tuple(a - b for a, b in zip(parent.whole, parent.left))


def laid_out(chosen: dict[int, Cut], whole: tuple[int, int, int], value: Callable[[int, int], float]) -> tuple[dict, dict[int, int]]:
    """The tree as arrays, root first, and where each path is in them."""
    nodes = sorted({1} | {c for k in chosen for c in (2 * k, 2 * k + 1)})
    place = {k: i for i, k in enumerate(nodes)}
    tree = {
        "slot": np.array([chosen[k].slot if k in chosen else 0 for k in nodes], np.int64),
        "bin": np.array([chosen[k].bin if k in chosen else 0 for k in nodes], np.int64),
        "left": np.array([place[2 * k] if k in chosen else -1 for k in nodes], np.int64),
        "right": np.array([place[2 * k + 1] if k in chosen else -1 for k in nodes], np.int64),
        "gain": np.array([chosen[k].gain if k in chosen else 0.0 for k in nodes], float),
        "value": np.array([0.0 if k in chosen else value(*sums_of(k, chosen, whole)[:2]) for k in nodes], float),
    }
    return tree, place


def _tree_text(tree: dict) -> dict:
    return {k: v.tolist() for k, v in tree.items()}


def _tree_of(text: dict) -> dict:
    return {k: np.array(v, float if k in ("gain", "value") else np.int64) for k, v in text.items()}


class Boosted:
    """Fitted trees; they score, name importances and are saved like one model."""

    def __init__(self, spark: SparkSession, cuts: list[np.ndarray], base: float, trees: list[dict], features: str):
        self.spark, self.cuts, self.base, self.trees, self.features = spark, cuts, base, trees, features

    @property
    def featureImportances(self) -> DenseVector:
        """The slots' shares of all gains."""
        gains = np.zeros(len(self.cuts))
        for tree in self.trees:
            inner = tree["left"] >= 0
            np.add.at(gains, tree["slot"][inner], tree["gain"][inner])
        return Vectors.dense(gains / max(gains.sum(), np.finfo(float).tiny))

    def transform(self, vectors: DataFrame) -> DataFrame:
        """The rows with ``probability`` and ``prediction``; a row without a vector has neither."""
        cuts, base, trees = self.cuts, self.base, self.trees

        @F.pandas_udf("double")
        def chance(values: pd.Series) -> pd.Series:
            told = values.notna().to_numpy()
            out = np.full(len(values), np.nan)
            if told.any():
                bins = binned(np.stack(values[told].to_list()), cuts)
                margin = np.full(len(bins), base)
                for tree in trees:
                    margin += tree["value"][walk(tree, bins)]
                out[told] = 1 / (1 + np.exp(-margin))
            return pd.Series(out).where(told, None)

        one = F.col("_one")
        values = F.when(F.col(self.features).isNotNull(), vector_to_array(self.features))
        return vectors.withColumn("_one", chance(values)).select(
            *vectors.columns,
            F.when(one.isNotNull(), array_to_vector(F.array(1 - one, one))).alias("probability"),
            (one > 0.5).cast("double").alias("prediction"),
        )

    def payloads(self) -> list[tuple[int, str]]:
        head = {"cuts": [c.tolist() for c in self.cuts], "base": self.base, "features": self.features}
        return [(0, json.dumps(head)), *[(i + 1, json.dumps([_tree_text(t)])) for i, t in enumerate(self.trees)]]

    def save(self, path: str) -> None:
        self.spark.createDataFrame(self.payloads(), _COMMITS).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        rows = sorted(spark.read.schema(_COMMITS).parquet(path).collect(), key=lambda r: r["round"])
        head = json.loads(rows[0]["payload"])
        trees = [_tree_of(t) for r in rows[1:] for t in json.loads(r["payload"])]
        return cls(spark, [np.array(c, float) for c in head["cuts"]], head["base"], trees, head["features"])


class BoostedClassifier:
    """An estimator of two classes, 0 and 1. A label or weight that is null, or a vector that is, keeps its row out of the fit."""

    def __init__(self, params: dict, features: str = "features", label: str = ROLES.target, weight: str = "weight", seed: int = SEED):
        self.settings, self.features, self.label, self.weight, self.seed = Settings.of(params), features, label, weight, seed
        self.folder: str | None = None
        self.data_id = ""
        self.kept = KEPT_ROUNDS
        self.cells = CELLS

    def restartable(self, folder: str, data_id: str) -> BoostedClassifier:
        """Rounds are committed below ``folder``; a later fit with the same parameters and ``data_id`` goes on after them."""
        self.folder, self.data_id = folder.rstrip("/"), data_id
        return self

    def fingerprint(self) -> str:
        return json.dumps([self.data_id, asdict(self.settings), self.features, self.label, self.seed], sort_keys=True)

    def fit(self, dataset: DataFrame) -> Boosted:
        spark = dataset.sparkSession
        own = self.folder is None
        path = fresh_folder(spark, "boost") if own else f"{self.folder}/boost-{zlib.crc32(self.fingerprint().encode()):08x}"
        if not exists(spark, f"{path}/commits"):
            self._begin(dataset, path)
        head, done = self._committed(spark, path)
        model = Boosted(spark, [np.array(c, float) for c in head["cuts"]], head["base"], done, self.features)
        while len(model.trees) < self.settings.n_estimators:
            start = len(model.trees)
            rows = spark.read.parquet(f"{path}/rows-{start}")
            until = min(start + self.kept, self.settings.n_estimators)
            for number in range(start, until):
                model.trees.append(self._round(rows, model, model.trees[start:], number, head))
            if until < self.settings.n_estimators:  # first the margins, then the commit, so one without the other is never read
                moved = self._moved(rows, model.trees[start:], len(model.cuts))
                moved.write.mode("overwrite").parquet(f"{path}/rows-{until}")
            if not own:
                self._commit(spark, path, until, [_tree_text(t) for t in model.trees[start:]])
            remove(spark, f"{path}/rows-{start}")
        if own:
            remove(spark, path)
        return model

    def _commit(self, spark: SparkSession, path: str, number: int, payload) -> None:
        entry = spark.createDataFrame([(number, json.dumps(payload))], _COMMITS)
        entry.coalesce(1).write.mode("append").parquet(f"{path}/commits")

    def _committed(self, spark: SparkSession, path: str) -> tuple[dict, list[dict]]:
        rows = sorted(spark.read.schema(_COMMITS).parquet(f"{path}/commits").collect(), key=lambda r: r["round"])
        return json.loads(rows[0]["payload"]), [_tree_of(t) for r in rows[1:] for t in json.loads(r["payload"])]

    def _begin(self, dataset: DataFrame, path: str) -> None:
        """Bins the rows and commits the cuts, the first margin and the unit of the whole-numbered gradients."""
        spark = dataset.sparkSession
        weight = F.col(self.weight).cast("double") if self.weight in dataset.columns else F.lit(1.0)
        key = F.col(ROLES.key) if ROLES.key in dataset.columns else F.monotonically_increasing_id()
        rows = dataset.select(
            F.xxhash64(key).alias("id"), F.col(self.label).cast("double").alias("y"), weight.alias("w"), F.col(self.features)
        ).dropna()
        n, total, most, ones = rows.agg(
            F.count("*"), F.sum("w"), F.max("w"), F.sum(F.col("w") * F.col("y"))
        ).first()
        if not n or not total > 0:
            raise ValueError("there are no weighed rows to fit")
        share = min(1 - 1e-9, max(1e-9, ones / total))
        base = log(share / (1 - share))
        cuts = bin_cuts(rows, self.features, self.settings.max_bins)
        unit = min(32, 61 - ceil(log2(max(total, most, n))))  # then no sum leaves 64 bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binned(matrix(batch.column(3)), cuts) if batch.num_rows else np.zeros((0, 0), np.uint8)
                margin = pa.array(np.full(batch.num_rows, base))
                coded = pa.array([b.tobytes() for b in bins], pa.binary())
                yield pa.record_batch([*batch.columns[:3], margin, coded], names=["id", "y", "w", "margin", "bins"])

        arrays = rows.withColumn(self.features, vector_to_array(self.features))
        coded = arrays.coalesce(max(1, ceil(n / TASK_ROWS))).mapInArrow(
            run, "id bigint, y double, w double, margin double, bins binary"
        )
        coded.write.mode("overwrite").parquet(f"{path}/rows-0")
        self._commit(spark, path, 0, {"cuts": [c.tolist() for c in cuts], "base": base, "unit": unit})

    def _moved(self, rows: DataFrame, trees: list[dict], width: int) -> DataFrame:
        """The rows with the margins after some more trees."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = byte_matrix(batch.column(4), width)
                margin = batch.column(3).to_numpy(zero_copy_only=False).copy()
                for tree in trees:
                    margin += tree["value"][walk(tree, bins)]
                yield pa.record_batch([*batch.columns[:3], pa.array(margin), batch.column(4)], names=batch.schema.names)

        return rows.select("id", "y", "w", "margin", "bins").mapInArrow(run, rows.schema)

    def _leaf(self, unit: int) -> Callable[[int, int], float]:
        s, scale = self.settings, 2.0**unit

        def value(g: int, h: int) -> float:
            pull = max(0.0, abs(g / scale) - s.reg_alpha) * (1 if g > 0 else -1)
            steep = h / scale + s.reg_lambda
            return -s.learning_rate * pull / steep if steep > 0 else 0.0

        return value

    def _round(self, rows: DataFrame, model: Boosted, since: list[dict], number: int, head: dict) -> dict:
        """One more tree. ``since`` are the trees that the stored margins don't hold yet."""
        s, unit = self.settings, head["unit"]
        width = len(model.cuts)
        draw = np.random.default_rng([self.seed, number])
        used = np.sort(draw.permutation(width)[: max(1, ceil(s.colsample_bytree * width))])
        mark = int(draw.integers(0, 2**63))
        leaf = self._leaf(unit)
        found: list[tuple[int, int, int]] = []  # the sums of the root

        def find(chosen: dict[int, Cut], wanted: list[int]) -> dict[int, Cut | None]:
            tree, place = laid_out(chosen, (0, 0, 0), leaf)
            open_, out = [], {}
            for node in wanted:
                _, h, n = sums_of(node, chosen, (0, 0, 0))
                small = node > 1 and (n < 2 * max(1, s.min_child_samples) or h < 2 * s.min_child_weight * 2.0**unit)
                out[node] = None
                open_ += [] if small else [node]
            at_once = max(1, self.cells // sum(len(model.cuts[i]) + 1 for i in used))
            for low in range(0, len(open_), at_once):
                some = open_[low : low + at_once]
                sums = self._sums(rows, since, tree, {place[k]: k for k in some}, used, model.cuts, mark, unit)
                for row in self._best(sums, unit).collect():
                    whole = (row["g_all"], row["h_all"], row["n_all"])
                    if row["node"] == 1:
                        found.append(whole)
                    if row["best"] is not None:
                        b = row["best"]
                        out[row["node"]] = Cut(b["gain"], -b["slot"], -b["bin"], (b["g_left"], b["h_left"], b["n_left"]), whole)
            return out

        chosen = grow(find, s.num_leaves or 2**s.max_depth, s.max_depth)
        return laid_out(chosen, found[0] if found else (0, 0, 0), leaf)[0]

    def _sums(
        self, rows: DataFrame, since: list[dict], tree: dict, wanted: dict[int, int], used: np.ndarray, cuts: list[np.ndarray], mark: int, unit: int
    ) -> DataFrame:
        """Whole-numbered gradients, second derivatives and rows per wanted node, slot and bin, once from each task."""
        width, share = len(cuts), self.settings.subsample
        sizes = np.array([len(cuts[i]) + 1 for i in used])
        offsets = np.cumsum(sizes) - sizes
        cells = int(sizes.sum())
        slot_of = np.repeat(used, sizes)
        bin_of = np.arange(cells) - np.repeat(offsets, sizes)
        number = np.full(len(tree["left"]), -1, np.int64)
        number[list(wanted)] = np.arange(len(wanted))
        names = np.array(list(wanted.values()), np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(names) * cells), np.int64)
            for whole in batches:
                for low in range(0, whole.num_rows, SLICE_ROWS):
                    batch = whole.slice(low, SLICE_ROWS)
                    ids, y, w, margin = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                    bins = byte_matrix(batch.column(4), width)
                    told = number[walk(tree, bins)]
                    keep = np.flatnonzero((told >= 0) & drawn(ids, mark, share))
                    bins, margin = bins[keep], margin[keep].copy()
                    for t in since:
                        margin += t["value"][walk(t, bins)]
                    p = 1 / (1 + np.exp(-margin))
                    g = np.rint((p - y[keep]) * w[keep] * 2.0**unit).astype(np.int64)
                    h = np.rint(p * (1 - p) * w[keep] * 2.0**unit).astype(np.int64)
                    at = (told[keep] * cells)[:, None] + offsets[None] + bins[:, used]
                    for k, x in enumerate((g, h, np.ones_like(g))):
                        np.add.at(total[k], at, x[:, None])
            some = np.flatnonzero(total[2])
            cell = some % cells
            columns = [names[some // cells], slot_of[cell].astype(np.int32), bin_of[cell].astype(np.int32), *total[:, some]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["node", "slot", "bin", "g", "h", "n"])

        tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
        sent = rows.select("id", "y", "w", "margin", "bins").coalesce(tasks).mapInArrow(run, _SUMS)
        # moved once: sums of a cell and running sums over the bins of a slot are both in its place
        return sent.repartition("node", "slot").groupBy("node", "slot", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])

    def _best(self, sums: DataFrame, unit: int) -> DataFrame:
        """One row per node: its sums, and its best cut if one is allowed and gains anything."""
        s, scale = self.settings, 2.0**unit
        of_slot = Window.partitionBy("node", "slot")
        up = of_slot.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sides = sums.select(
            "*", *[F.sum(c).over(up).alias(f"{c}_left") for c in "ghn"], *[F.sum(c).over(of_slot).alias(f"{c}_all") for c in "ghn"]
        )

        def score(g: Column, h: Column) -> Column:
            pull = F.greatest(F.lit(0.0), F.abs(g / scale) - F.lit(float(s.reg_alpha)))
            steep = h / scale + F.lit(float(s.reg_lambda))
            return F.when(steep > 0, pull * pull / steep).otherwise(F.lit(0.0))

        left, whole = [F.col(f"{c}_left") for c in "ghn"], [F.col(f"{c}_all") for c in "ghn"]
        right = [w - x for w, x in zip(whole, left)]
        gain = (score(*left[:2]) + score(*right[:2]) - score(*whole[:2])) / 2 - F.lit(float(s.gamma))
        least, weight = F.lit(max(1, s.min_child_samples)), F.lit(s.min_child_weight * scale)
        allowed = (left[2] >= least) & (right[2] >= least) & (left[1] >= weight) & (right[1] >= weight)
        told = F.struct(
            gain.alias("gain"), (-F.col("slot")).alias("slot"), (-F.col("bin")).alias("bin"), "g_left", "h_left", "n_left"
        )  # of equal gains the first slot's first bin
        best = F.max(F.when(allowed & (gain > 0), told)).alias("best")
        return sides.groupBy("node").agg(best, *[F.max(f"{c}_all").alias(f"{c}_all") for c in "ghn"])
