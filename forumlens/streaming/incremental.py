"""Backfill and export that pick up where the last run stopped.

A stream reads new source files, and every batch writes one numbered directory of the target. A batch that runs
again after a failure replaces its own directory, so the target has each item once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from forumlens.operators import store as ops
from forumlens.operators.embedding import Embedder
from forumlens.plans import maintenance
from forumlens.schemas import EMBEDDING_STORE, VECTOR_EXPORT
from forumlens.sources.snapshots import read_batches, write_batch

_DATE_COLUMN = {ops.POST: "post_date", ops.THREAD: "last_post_date"}


def item_stream(spark: SparkSession, directory: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Posts or threads that arrive as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def _stored_before(spark: SparkSession, directory: str, batch_id: int, existing: DataFrame | None) -> DataFrame:
    """Ids already stored: in earlier batches of this store, and in ``existing`` rows kept elsewhere."""
    if batch_id == 0:
        stored = spark.createDataFrame([], EMBEDDING_STORE)
    else:
        stored = read_batches(spark, directory, EMBEDDING_STORE, before=batch_id).drop("batch_id")
    keys = list(ops.KEYS.values())
    return stored.select(keys) if existing is None else stored.select(keys).union(existing.select(keys))


def start_backfill(
    items: DataFrame,
    store_directory: str,
    quarantine_directory: str,
    checkpoint_directory: str,
    kind: str,
    embedder: Embedder,
    dim: int,
    existing: DataFrame | None = None,
) -> StreamingQuery:
    """Embed every streamed item that the store lacks, then stop. Of an item that arrives twice the newest counts."""
    key = ops.KEYS[kind]

    def run(batch: DataFrame, batch_id: int) -> None:
        stored = _stored_before(batch.sparkSession, store_directory, batch_id, existing)
        # The files of the batch are read again, not shuffled, to find what arrived twice.
        newest = ops.newest(batch, key, _DATE_COLUMN[kind])
        rows = maintenance.backfill(newest, stored, kind, embedder, dim, F.current_timestamp()).persist()
        try:
            write_batch(maintenance.accepted(rows), store_directory, batch_id)
            write_batch(maintenance.quarantined(rows), quarantine_directory, batch_id)
        finally:
            rows.unpersist()

    return (
        items.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_directory)
        .trigger(availableNow=True)
        .start()
    )


def start_export(rows: DataFrame, target_directory: str, checkpoint_directory: str, dim: int) -> StreamingQuery:
    """Export every streamed store row that is valid, then stop."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(maintenance.export_rows(batch, dim), target_directory, batch_id)

    return (
        rows.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_directory)
        .trigger(availableNow=True)
        .start()
    )


def read_export(spark: SparkSession, directory: str) -> DataFrame:
    """The exported vectors, the last batch of a post winning. A batch has a post once, so ids and batch numbers decide;
    vectors stay where they are while few posts are in several batches."""
    rows = read_batches(spark, directory, VECTOR_EXPORT)
    counted = rows.groupBy("post_id").agg(F.max("batch_id").alias("last"), F.count("*").alias("n"))
    repeated = counted.where(F.col("n") > 1).select("post_id", "last")
    kept = rows.join(repeated, "post_id", "left").where(F.col("last").isNull() | (F.col("batch_id") == F.col("last")))
    return kept.select(*VECTOR_EXPORT.names)
