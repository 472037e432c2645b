"""Published versions of a folder whose parts never change.

A writer first writes new parts, which nobody reads yet, and then publishes a version that names the parts that count. A
version is one small table, so it is there as a whole or not at all, and a writer that stops halfway leaves the version
before it readable. Two writers cannot publish the same version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_if_there(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """A table, or None where no such folder is."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def published(spark: SparkSession, directory: str, schema: str) -> dict | None:
    """The last published version as a dict with ``version`` and the columns of ``schema``; None before the first."""
    rows = read_if_there(spark, f"{directory}/versions", f"{schema}, version int")
    last = rows.orderBy(F.col("version").desc()).limit(1).collect() if rows is not None else []
    return last[0].asDict() if last else None


def publish(spark: SparkSession, directory: str, version: int, schema: str, *values) -> None:
    """Publish a version; its number must be new."""
    row = spark.createDataFrame([values], schema)
    row.coalesce(1).write.mode("errorifexists").parquet(f"{directory}/versions/version={version}")
