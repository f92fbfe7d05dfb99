"""Reading and writing: SQL text, CSV, parquet, JSON and database tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import PySparkException

from lodgewise.schema import BOOKING_COLUMNS, BOOKING_DDL, ROLES

VIEW = "noshow"
DEFAULT_SQL = f"SELECT * FROM {VIEW} LIMIT 100"


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def database_table(spark: SparkSession, url: str, table: str = VIEW, **options: str) -> DataFrame:
    """A database table over JDBC.

    With ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` the read is split
    over executors; without them it is one task, which suits small tables only.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType = BOOKING_DDL) -> DataFrame:
    """CSV with a header. Columns go by name, in any order; those of the schema come first, with its types.

    Values that don't fit their type are null, columns beyond the schema stay text, and a missing one is an error.
    """
    told = spark.read.option("header", True).csv(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [name for name in wanted.names if name not in told.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted]
    return told.select(*typed, *[F.col(f"`{name}`") for name in told.columns if name not in wanted.names])


def register(df: DataFrame, view: str = VIEW) -> DataFrame:
    df.createOrReplaceTempView(view)
    return df


def load(spark: SparkSession, query: str) -> DataFrame:
    """Run SQL text, with or without a closing semicolon."""
    return spark.sql(query.strip().rstrip(";"))


def canonical(df: DataFrame) -> DataFrame:
    """The fifteen booking columns of rows whose outcome is known."""
    return df.select(*BOOKING_COLUMNS).where(F.col(ROLES.target).isNotNull())


def execute(spark: SparkSession, query: str = DEFAULT_SQL) -> DataFrame | dict[str, str]:
    """Ad-hoc SQL, not run yet. A query that does not analyse comes back as ``{"error": ...}``; see `answer`."""
    try:
        return load(spark, query)
    except PySparkException as e:
        return _refused(e)


def _refused(why: Exception) -> dict[str, str]:
    return {"error": f"this SQL gave no result. {why}"}


def answer(spark: SparkSession, query: str = DEFAULT_SQL, rows: int = 50) -> dict:
    """The `preview` of what ad-hoc SQL gives, or ``{"error": ...}`` if it does not analyse or stops while it runs."""
    found = execute(spark, query)
    if isinstance(found, dict):
        return found
    try:
        return preview(found, rows)
    except (PySparkException, Py4JJavaError) as e:
        return _refused(e)


def preview(df: DataFrame, rows: int = 50) -> dict:
    """Row and column counts, column names and the first rows."""
    return {
        "rows": df.count(),
        "columns": len(df.columns),
        "names": df.columns,
        "head": [r.asDict() for r in df.limit(rows).collect()],
    }


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def infer_roles(df: DataFrame, target: str = ROLES.target, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical column names by type, without the target."""
    skip = {target, *exclude}
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    text = [
        f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in skip
    ]
    return numeric, text
