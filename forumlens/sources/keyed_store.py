"""An embedding store on disk whose changes rewrite only the buckets that they touch.

Rows lie in buckets by their key, the post or else the thread that they belong to. A change reads and writes the buckets of
its keys; a published version says which writing of every bucket counts, so readers see a change as a whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from forumlens.operators import store as ops
from forumlens.sources.snapshots import materialize
from forumlens.sources.versions import publish, published

BUCKETS = 1024
# ``places[b]`` is the version that wrote bucket b last, -1 for an empty bucket.
_VERSION = "places array<int>"


def _bucket(count: int) -> Column:
    """Rows of one post or thread share a bucket; rows without either are spread by their own key."""
    post, thread = F.nullif("post_id", F.lit(0)), F.nullif("thread_id", F.lit(0))
    key = F.when(post.isNotNull(), F.xxhash64(F.lit(0), post)).when(thread.isNotNull(), F.xxhash64(F.lit(1), thread))
    return F.pmod(key.otherwise(F.xxhash64(F.lit(2), "vec_id")), F.lit(count)).cast("int")


def _folder(directory: str, version: int) -> str:
    return f"{directory}/rows/version={version}"


def _write(rows: DataFrame, directory: str, version: int, places: list[int], touched: list[int]) -> None:
    """Write the rows of the touched buckets and publish them. What an earlier writer left of this version is replaced."""
    target = _folder(directory, version)
    rows.withColumn("bucket", _bucket(len(places))).write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = rows.sparkSession.read.schema(StructType([*rows.schema.fields]).add("bucket", "integer")).parquet(target)
    filled = {row[0] for row in written.select("bucket").distinct().collect()}
    for bucket in touched:
        places[bucket] = version if bucket in filled else -1
    publish(rows.sparkSession, directory, version, _VERSION, places)


def create(rows: DataFrame, directory: str, buckets: int = BUCKETS) -> None:
    """A new store of ``rows``. Rows are dealt to their buckets once; a bucket is written by one task."""
    found = published(rows.sparkSession, directory, _VERSION)
    if found:
        raise ValueError(f"{directory} holds a store")
    dealt = rows.repartition(_bucket(buckets))
    _write(dealt, directory, 0, [-1] * buckets, list(range(buckets)))


def read(spark: SparkSession, directory: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the last published version, of some buckets or of all."""
    found = published(spark, directory, _VERSION)
    if not found:
        raise ValueError(f"no store was published in {directory}")
    places = found["places"]
    chosen = [b for b in (range(len(places)) if buckets is None else buckets) if places[b] >= 0]
    if not chosen:
        return spark.createDataFrame([], schema)
    paths = [f"{_folder(directory, places[b])}/bucket={b}" for b in chosen]
    return spark.read.schema(schema).parquet(*paths)


def _change(rows: DataFrame, directory: str, schema: StructType, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    spark = rows.sparkSession
    found = published(spark, directory, _VERSION)
    places, rows = list(found["places"]), materialize(rows)
    keyed = rows if "vec_id" in rows.columns else rows.withColumn("vec_id", F.lit(None).cast("long"))
    # At most as many numbers as the store has buckets.
    touched = sorted(row[0] for row in keyed.select(_bucket(len(places)).alias("b")).distinct().collect())
    if touched:
        _write(merge(read(spark, directory, schema, touched), rows), directory, found["version"] + 1, places, touched)
    return touched


def upsert(rows: DataFrame, directory: str, schema: StructType, key: str) -> list[int]:
    """Insert rows, or merge them into the row that has their key; see :func:`forumlens.operators.store.upsert`. Returns the
    buckets that were written."""
    return _change(rows, directory, schema, lambda stored, new: ops.upsert(stored, new, key))


def update(rows: DataFrame, directory: str, schema: StructType, key: str, now: Column) -> list[int]:
    """Replace the vectors of known keys; see :func:`forumlens.operators.store.update_existing`."""
    return _change(rows, directory, schema, lambda stored, new: ops.update_existing(stored, new, key, now))


def delete(ids: DataFrame, directory: str, schema: StructType, key: str) -> list[int]:
    """Delete rows by key (a column ``key``)."""
    names = [field.name for field in schema if field.name in ("post_id", "thread_id", "vec_id")]
    whole = reduce(lambda rows, name: rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("long")), names, ids)
    return _change(whole.select(names), directory, schema, lambda stored, gone: stored.join(gone.select(key), key, "left_anti").select(schema.names))
