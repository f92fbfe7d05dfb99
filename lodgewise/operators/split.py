"""Reproducible splits, folds and samples by hash order, without sorting the table.

Rows are ordered by ``md5(seed|id)``. The hash is uniform, so its first four hex digits cut any
class into 65,536 even buckets. Counts per bucket tell in which bucket each cut falls; only the
rows of that bucket are ranked to find the exact cut. Every row is then compared with the few cuts
of its class, in the scan: the table is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgewise.schema import CV_FOLDS, ROLES, SAMPLE_ROWS, SEED, TEST_SIZE, VALIDATION_SIZE
from lodgewise.session import stored

_PREFIX_DIGITS = 4
_BEFORE_ALL, _AFTER_ALL = "", "g"  # hex digits lie between these


def order_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _blocks(
    df: DataFrame, group: Column, key: str, sizes: Callable[[dict], dict[object, list[int]]], seed: int, name: str
) -> DataFrame:
    """Number the consecutive blocks of each group in hash order, given their exact sizes.

    ``sizes`` maps {group: rows} to {group: block sizes}. Rows of a NULL group get NULL. Groups are
    classes of a target, a handful; what reaches the driver is their sizes and cuts.
    """
    columns = df.columns
    rows = df.withColumns({"_group": group, "_hash": order_hash(F.col(key), seed)}).withColumn(
        "_prefix", F.substring("_hash", 1, _PREFIX_DIGITS)
    )
    counts = stored(
        rows.where(F.col("_group").isNotNull()).groupBy("_group", "_prefix").agg(F.count("*").alias("n")), "hashes"
    )
    totals = {r["_group"]: r["n"] for r in counts.groupBy("_group").agg(F.sum("n").alias("n")).collect()}
    ranks = [
        (g, i, rank, totals[g])
        for g, parts in sizes(totals).items()
        for i, rank in enumerate(accumulate(parts[:-1]), start=1)
    ]
    if not ranks:
        return df.withColumn(name, F.when(group.isNotNull(), F.lit(0)))
    spark = df.sparkSession
    group_type = rows.schema["_group"].dataType.simpleString()
    wanted = spark.createDataFrame(
        [(g, i, r) for g, i, r, n in ranks if 0 < r < n], f"_group {group_type}, cut int, rank bigint"
    )
    earlier = F.sum("n").over(
        Window.partitionBy("_group").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    )
    places = (
        counts.select("_group", "_prefix", "n", F.coalesce(earlier, F.lit(0)).alias("start"))
        .join(F.broadcast(wanted), "_group")
        .where("rank > start and rank <= start + n")
        .select("_group", "_prefix", "cut", (F.col("rank") - F.col("start")).alias("place"))
    )
    places = stored(places, "cuts")
    at = F.row_number().over(Window.partitionBy("_group", "cut").orderBy("_hash", key))
    found = (
        rows.select("_group", "_prefix", "_hash", key)
        .join(places, ["_group", "_prefix"])
        .select("*", at.alias("_at"))
        .where("_at = place")
        .select("_group", "cut", "_hash", key)
        .collect()
    )
    cuts = {(g, i): (_BEFORE_ALL if r <= 0 else _AFTER_ALL, None) for g, i, r, _ in ranks}
    cuts.update({(r["_group"], r["cut"]): (r["_hash"], r[key]) for r in found})
    n_cuts = max(i for _, i in cuts)
    key_type = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"_hash_{i} string, _key_{i} {key_type}" for i in range(1, n_cuts + 1))
    table = spark.createDataFrame(
        [
            (g, *[v for i in range(1, n_cuts + 1) for v in cuts.get((g, i), (_AFTER_ALL, None))])
            for g in {g for g, _ in cuts}
        ],
        f"_group {group_type}, {fields}",
    )
    block = F.lit(0)
    for i in range(1, n_cuts + 1):
        same = (F.col("_hash") == F.col(f"_hash_{i}")) & (F.col(key) > F.col(f"_key_{i}"))
        block = block + ((F.col("_hash") > F.col(f"_hash_{i}")) | same).cast("int")
    return rows.join(F.broadcast(table), "_group", "left").withColumn(name, block).select(*columns, name)


def _proportional(counts: dict, draws: int) -> dict:
    """``draws`` shared out in proportion to ``counts``; leftovers go to the largest remainders."""
    n = sum(counts.values())
    exact = {g: c / n * draws for g, c in counts.items()}
    share = {g: floor(x) for g, x in exact.items()}
    order = sorted(counts, key=lambda g: (share[g] - exact[g], g))
    for g in order[: draws - sum(share.values())]:
        share[g] += 1
    return share


def split_sizes(counts: dict, test: float, validation: float) -> dict[object, list[int]]:
    """Rows per class for [test, validation, train]: first the test rows, then a share of the rest."""
    n = sum(counts.values())
    rest = _proportional(counts, n - ceil(n * test))
    n_rest = sum(rest.values())
    train = _proportional(rest, n_rest - ceil(n_rest * validation))
    return {g: [counts[g] - rest[g], rest[g] - train[g], train[g]] for g in counts}


def stratified_split(
    df: DataFrame,
    target: str = ROLES.target,
    key: str = ROLES.key,
    test: float = TEST_SIZE,
    validation: float = VALIDATION_SIZE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: test, val or train, each with the class mix of the whole."""
    blocks = _blocks(df, F.col(target), key, lambda counts: split_sizes(counts, test, validation), seed, "_block")
    names = F.array(F.lit("test"), F.lit("val"), F.lit("train"))
    return blocks.withColumn("split", F.get(names, F.col("_block"))).drop("_block")


def kfold(
    df: DataFrame, folds: int = CV_FOLDS, target: str = ROLES.target, key: str = ROLES.key, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` 0..folds-1; per class the sizes differ by at most one row."""

    def sizes(counts: dict) -> dict:
        return {g: [n // folds + (i < n % folds) for i in range(folds)] for g, n in counts.items()}

    return _blocks(df, F.col(target), key, sizes, seed, "fold")


def sample_n(df: DataFrame, n: int = SAMPLE_ROWS, key: str = ROLES.key, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer: the first in hash order."""
    blocks = _blocks(df, F.lit(0), key, lambda counts: {g: [n, max(c - n, 0)] for g, c in counts.items()}, seed, "_b")
    return blocks.where("_b = 0").drop("_b")


def class_weights(df: DataFrame, target: str = ROLES.target) -> DataFrame:
    """Per class: balanced weight (total / 2 rows) and positive weight (negatives / positives)."""
    row = df.agg(F.count_if(F.col(target) == 0).alias("neg"), F.count_if(F.col(target) == 1).alias("pos"))
    total = F.col("neg") + F.col("pos")

    def entry(label: int, n: str, positive: Column) -> Column:
        balanced = F.try_divide(total, F.lit(2) * F.col(n))
        return F.struct(
            F.lit(label).alias(target), F.col(n).alias("n"), balanced.alias("balanced"), positive.alias("neg_over_pos")
        )

    return row.select(
        F.inline(F.array(entry(0, "neg", F.lit(1.0)), entry(1, "pos", F.try_divide("neg", "pos"))))
    )


def with_weights(df: DataFrame, scheme: str, target: str = ROLES.target, name: str = "weight") -> DataFrame:
    """Attach class weights; ``scheme`` is balanced or neg_over_pos."""
    weights = F.broadcast(class_weights(df, target).select(target, F.col(scheme).alias(name)))
    return df.join(weights, target)


def named(df: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> list[DataFrame]:
    return [df.where(F.col("split") == s).drop("split") for s in splits]
