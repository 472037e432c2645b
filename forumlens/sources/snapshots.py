"""Snapshots: written tables that replace a store version or cut a long lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType


def scratch_directory(spark: SparkSession) -> str:
    """A fresh directory in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine, since no other machine reads it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/forumlens-{uuid.uuid4().hex}"


def write_snapshot(rows: DataFrame, directory: str) -> DataFrame:
    """Write rows as a new snapshot and read it back. The target must not be the source of ``rows``."""
    rows.write.mode("errorifexists").parquet(directory)
    return rows.sparkSession.read.schema(rows.schema).parquet(directory)


def materialize(rows: DataFrame) -> DataFrame:
    """Compute rows once into the shared folder; later readers neither recompute nor lose them."""
    return write_snapshot(rows, scratch_directory(rows.sparkSession))


def write_slices(rows: DataFrame, count: int) -> str:
    """Write rows into the shared folder in slices of at most ``count`` rows; tasks read them by :func:`read_slices`."""
    folder = scratch_directory(rows.sparkSession)
    rows.write.option("parquet.block.row.count.limit", count).parquet(folder)
    uri = folder if "://" in folder or ":/" in folder else f"file://{folder}"
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def read_slices(uri: str) -> Iterator[pa.Table]:
    """The row groups of a Parquet folder, one at a time, through Arrow's file systems."""
    files, path = pa.fs.FileSystem.from_uri(uri)
    found = files.get_file_info(pa.fs.FileSelector(path))
    for name in sorted(one.path for one in found if one.base_name.endswith(".parquet")):
        with files.open_input_file(name) as file:
            parquet = pq.ParquetFile(file)
            for number in range(parquet.num_row_groups):
                yield parquet.read_row_group(number)


def write_bucketed(rows: DataFrame, directory: str, key: str, buckets: int) -> DataFrame:
    """Write rows into buckets by key and read them back. Joins on the key then leave these rows where they are."""
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", directory).mode("errorifexists").saveAsTable(name)
    return rows.sparkSession.table(name)


def read_bucketed(spark: SparkSession, directory: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """Rows that :func:`write_bucketed` wrote, in another session perhaps."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    place = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{directory}'"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {place}")
    return spark.table(name)


def is_complete(spark: SparkSession, directory: str) -> bool:
    """Whether a write to the directory has ended: writers leave a marker when they commit."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def build_if_missing(rows: DataFrame, directory: str) -> DataFrame:
    """The snapshot in ``directory``, built from ``rows`` when it is not there, or not whole after a lost writer."""
    if not is_complete(rows.sparkSession, directory):
        rows.write.mode("overwrite").parquet(directory)
    return rows.sparkSession.read.schema(rows.schema).parquet(directory)


def write_batch(rows: DataFrame, directory: str, batch_id: int) -> None:
    """Write one numbered batch of a store. Writing the same batch again replaces it."""
    rows.write.mode("overwrite").parquet(f"{directory}/batch_id={batch_id}")


def read_batches(spark: SparkSession, directory: str, schema: StructType, before: int | None = None) -> DataFrame:
    """All batches of a store, or those numbered below ``before``; the batch number prunes directories."""
    numbered = StructType([*schema.fields, StructField("batch_id", LongType())])
    rows = spark.read.schema(numbered).parquet(directory)
    if before is not None:
        rows = rows.where(rows["batch_id"] < before)
    return rows
