"""From raw documents to packed token rows: filter, deduplicate, decontaminate, mix, pack.

Each stage takes the documents that its predecessor kept, and all but the last give back documents with the columns
they came with. The tables beside ``documents`` are read from ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodgewise.llm import decontaminate, jaccard_join, mixing, packing, toxicity
from lodgewise.llm.common import table
from lodgewise.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of a batch of rows on its way to Python: each task holds some of them, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session that hands rows to Python in batches of bounded size, as texts may be long.

    What a query has shuffled goes when the query ends; else it stays on disk until the driver happens to collect garbage.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        return stage(spark, docs, sf_dir)

    return run


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the classifier learns from the documents of this stage."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8 or more: the least id."""
    return jaccard_join.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to a fifth of its words edited."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weight, one row per copy, in training order."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2,048 token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", in_small_batches(without_toxic)),
    ("near-duplicates", in_small_batches(without_near_copies)),
    ("decontamination", in_small_batches(without_benchmark)),
    ("mixing", in_small_batches(mixed)),
    ("packing", in_small_batches(packed)),
]

#: SQL has neither the learnt classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
