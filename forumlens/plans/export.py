"""Vector export into a folder, in published versions.

One pass over the store writes valid vectors and, beside them, the rows that were rejected with their reasons; the counters
are taken by that same pass. A version then names the parts that count: only the new one if the export begins anew, else the
earlier ones as well. Which row of a post counts is decided on ids alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from forumlens.functions import vectors
from forumlens.sources.versions import publish, published

_VERSION = "parts array<int>"
_IDS = "post_id bigint, vec_id bigint, part int"
_ROWS = "post_id bigint, vec_id bigint, embedding array<float>, embedding_length int, reason string, valid boolean"


@dataclass(frozen=True)
class ExportCounts:
    """Rows read, and rows that are valid."""

    processed: int
    exported: int


def _folder(directory: str, kind: str, part: int) -> str:
    return f"{directory}/{kind}/part={part}"


def export(store: DataFrame, dim: int, directory: str, drop_first: bool = False, after: int = 0) -> ExportCounts:
    """Export the vectors of all posts above ``after`` and publish them.

    ``drop_first`` begins anew; else the folder is made if it is missing and added to if it is there. Until the version is
    published, readers see the one before it; a run that stops early leaves a part that no version names, which the next
    run replaces.
    """
    spark = store.sparkSession
    found = published(spark, directory, _VERSION)
    part = found["version"] + 1 if found else 0
    reason = vectors.validation_reason(F.col("embedding"), dim)
    rows = store.where(F.col("post_id") > after).select("post_id", "vec_id", "embedding", "embedding_length", reason.alias("reason"))
    rows = rows.withColumn("valid", F.col("reason") == "valid")
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if("valid").alias("exported"))
    rows.write.mode("overwrite").partitionBy("valid").parquet(_folder(directory, "rows", part))
    parts = [part] if drop_first or not found else [*found["parts"], part]
    publish(spark, directory, part, _VERSION, parts)
    return ExportCounts(**seen.get)


def _rows(spark: SparkSession, directory: str) -> DataFrame:
    found = published(spark, directory, _VERSION)
    if not found:
        raise ValueError(f"no export was published in {directory}")
    read = spark.read.schema(f"{_ROWS}, part int").option("basePath", f"{directory}/rows")
    return read.parquet(*[_folder(directory, "rows", part) for part in found["parts"]])


def read_export(spark: SparkSession, directory: str) -> DataFrame:
    """``post_id, embedding, embedding_length``: one row per exported post, the last of the last part.

    Posts with several rows are found on their ids; vectors stay where they are while such posts are few.
    """
    good = _rows(spark, directory).where("valid")
    last = good.groupBy("post_id").agg(F.max(F.struct("part", "vec_id")).alias("last"), F.count("*").alias("n"))
    repeated = last.where(F.col("n") > 1).select("post_id", "last")
    kept = good.join(repeated, "post_id", "left").where(F.col("last").isNull() | (F.struct("part", "vec_id") == F.col("last")))
    return kept.select("post_id", "embedding", "embedding_length")


def read_rejected(spark: SparkSession, directory: str) -> DataFrame:
    """``post_id, vec_id, reason`` of the rows that were left out."""
    return _rows(spark, directory).where("not valid").select("post_id", "vec_id", "reason")
