"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lodgewise", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LODGEWISE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        # inputs here are small: keep them split over the cores anyway
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own, one per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="lodgewise-")
    return _own_folders[context.applicationId]


def stored(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    The read has no lineage to the jobs that made it, so later passes survive lost executors,
    prune columns at the scan, and broadcast the table only if its files are small enough for
    ``spark.sql.autoBroadcastJoinThreshold``. Beyond that Spark sorts and merges, and adaptive
    execution splits hot keys. With ``by``, each value of that column has a folder of its own, and
    filters on it skip the others.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _located(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that the caller has written; nothing happens if there is none."""
    system, place = _located(spark, path)
    system.delete(place, True)
