"""Reading, checking and changing the embedding store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType

from forumlens.functions import vectors
from forumlens.operators.joins import nullable_key_left_join
from forumlens.schemas import UPSERT_COLUMNS
from forumlens.sources.snapshots import materialize

POST = "post"
THREAD = "thread"
KEYS = {POST: "post_id", THREAD: "thread_id"}


def present(key: str) -> Column:
    """Ids are absent when they are NULL or 0."""
    return F.coalesce(F.col(key), F.lit(0)) != 0


def with_kind(rows: DataFrame) -> DataFrame:
    """Tag each row as post or thread; a row with both ids is a post."""
    return rows.withColumn("type", F.when(present("post_id"), POST).when(present("thread_id"), THREAD))


def with_dates(store: DataFrame, posts: DataFrame, threads: DataFrame) -> DataFrame:
    """Store rows with the date of their post, or else of their thread. Row keys (``vec_id``) are unique.

    Dates are found for the ids alone and meet the rows by their key: vectors move once at most, and not at all if the
    store is bucketed by ``vec_id`` (:func:`forumlens.sources.snapshots.write_bucketed`).
    """
    dated = nullable_key_left_join(
        store.select("vec_id", "post_id", "thread_id"), posts.select("post_id", "post_date"), "post_id", "vec_id"
    )
    dated = nullable_key_left_join(dated, threads.select("thread_id", "last_post_date"), "thread_id", "vec_id")
    dates = dated.select("vec_id", F.coalesce("post_date", "last_post_date").alias("date"))
    return store.join(dates, "vec_id", "left").select(*store.columns, "date")


def lookup(items: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Items with the given ids; ids without an item are skipped."""
    return items.join(ids.select(key).distinct(), key, "left_semi")


def lookup_one(items: DataFrame, key: str, value: int) -> DataFrame:
    """One item by id; the predicate reaches the scan."""
    return items.where(F.col(key) == value)


def titles_of(hits: DataFrame, posts: DataFrame, threads: DataFrame, few: bool) -> DataFrame:
    """The threads that the posts of some hits belong to. Only ids take part until the threads are chosen.

    There are no more of these threads than hits, so if the hits fit a broadcast their thread ids do, too.
    """
    wanted = hits.select("post_id")
    ids = posts.select("post_id", "thread_id").join(F.broadcast(wanted) if few else wanted, "post_id")
    ids = ids.select("thread_id").distinct()
    return threads.join(F.broadcast(ids) if few else ids, "thread_id", "left_semi")


def missing(ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Ids that no item has. A missing id is NULL or 0 for rows of the other kind; those are not asked."""
    return ids.where(present(key)).select(key).distinct().join(items.select(key), key, "left_anti")


def keyset_page(rows: DataFrame, key: str, size: int, after: int = 0) -> DataFrame:
    """The ``size`` rows that follow ``after`` in key order."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def offset_page(rows: DataFrame, key: str, size: int, offset: int, ranges: int | None = None) -> DataFrame:
    """The ``size`` rows after the first ``offset`` ones in key order, NULL keys first.

    Keys alone are dealt into ranges and counted. Sums of the counts tell which ranges hold the page, and only rows
    between their ends are read, so no task sorts more than a range and the page. ``ranges`` defaults to the shuffle
    partitions.
    """
    spark = rows.sparkSession
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key).where(F.col(key).isNotNull()).repartitionByRange(count, key)
    dealt = materialize(dealt.withColumn("range_no", F.spark_partition_id()))
    sizes = dealt.groupBy("range_no").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    before = rows.where(F.col(key).isNull()).count()
    if offset < before:  # the page begins among rows without a key, which have no order
        return rows.orderBy(key).offset(offset).limit(size)
    first = last = None
    skipped, held = before, 0
    for row in sizes.orderBy("range_no").collect():  # as many rows as ranges
        if first is None and skipped + row["n"] <= offset:
            skipped += row["n"]
            continue
        first = row["first"] if first is None else first
        last, held = row["last"], held + row["n"]
        if skipped + held >= offset + size:
            break
    if first is None:
        return rows.limit(0)
    return rows.where(F.col(key).between(first, last)).orderBy(key).offset(offset - skipped).limit(size)


def embedded_ids(store: DataFrame, key: str) -> DataFrame:
    return store.where(F.col(key).isNotNull()).select(key).distinct()


def pending_ids(items: DataFrame, store: DataFrame, key: str, after: int = 0) -> DataFrame:
    ids = items.where(F.col(key) > after).select(key)
    return ids.join(store.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def pending(items: DataFrame, store: DataFrame, key: str, after: int = 0) -> DataFrame:
    """Items without a vector.

    The ids are found first and written, so that their true size decides the second join: while few are pending,
    the texts are read without a shuffle.
    """
    return items.join(materialize(pending_ids(items, store, key, after)), key, "left_semi")


def orphans(store: DataFrame, posts: DataFrame, threads: DataFrame) -> DataFrame:
    """Vectors whose post or thread is gone."""
    tagged = with_kind(store.drop("embedding"))
    lost_posts = tagged.where(F.col("type") == POST).join(posts.select("post_id"), "post_id", "left_anti")
    lost_threads = tagged.where(F.col("type") == THREAD).join(threads.select("thread_id"), "thread_id", "left_anti")
    return lost_posts.unionByName(lost_threads)


def last_wins(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, whole: the one with the highest version; NULL is below every version, and among equal versions
    the content decides, by its hash, so that the answer does not depend on the order of rows.

    ``max_by`` combines within each task first, so a key that holds much of the data shuffles one row per task.
    """
    others = [c for c in rows.columns if c != key]
    ties = F.xxhash64(*others)
    order = F.struct(F.col(version).isNotNull(), F.col(version), ties)
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("row"))
    return kept.select(key, "row.*").select(*rows.columns)


def newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows with one per key, as :func:`last_wins` takes it, where few keys repeat.

    Keys alone are counted, and only rows of repeated keys move whole. ``rows`` is read twice and should be a written
    table. Rows without a key all stay.
    """
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_of_key"))
    repeated = materialize(counted.where(F.col("rows_of_key") > 1).select(key))
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, key, "left_anti").select(*rows.columns)
    return once.unionByName(last_wins(rows.join(repeated, key, "left_semi").select(*rows.columns), key, version))


def upsert(store: DataFrame, rows: DataFrame, key: str, update: tuple[str, ...] = UPSERT_COLUMNS) -> DataFrame:
    """The store with rows inserted, or merged into the row that has their key.

    An existing key takes only the ``update`` columns. Of rows that repeat a key one is taken, the last updated, so
    the store never gains a row for a key that it has. ``rows`` is read several times and should be a written table. A
    small batch is broadcast by Spark for the merge, and only ids take part in finding repeated and new keys.
    """
    rows = newest(rows, key, "last_updated")
    merged = _replace(store, rows, key, {c: F.col(f"_new_{c}") for c in update}, update)
    fresh = rows.join(store.where(F.col(key).isNotNull()).select(key), key, "left_anti")
    return merged.unionByName(fresh, allowMissingColumns=True).select(*store.columns)


def update_existing(store: DataFrame, rows: DataFrame, key: str, now: Column, unique: bool = False) -> DataFrame:
    """The store with vectors of known keys replaced and their time set; other rows are not added.

    Of rows that repeat a key the last updated is taken: the store keeps its rows. ``unique`` says that none do; else
    ``rows`` should be a written table.
    """
    rows = rows if unique else newest(rows, key, "last_updated")
    values = {c: F.col(f"_new_{c}") for c in UPSERT_COLUMNS}
    return _replace(store, rows, key, values | {"last_updated": now}, UPSERT_COLUMNS).select(*store.columns)


def _replace(store: DataFrame, rows: DataFrame, key: str, values: dict[str, Column], names: tuple[str, ...]):
    changes = rows.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = nullable_key_left_join(store, changes, key, "vec_id")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.select(
        *[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in store.columns]
    )


def delete_kind(store: DataFrame, kind: str | None) -> DataFrame:
    """The store without the rows of one kind, or without any row."""
    if kind is None:
        return store.where(F.lit(False))
    return store.where(F.col(KEYS[kind]).isNull())


def of_kind(store: DataFrame, kind: str | None) -> DataFrame:
    return store if kind is None else store.where(F.col(KEYS[kind]).isNotNull())


def decoded(store: DataFrame) -> DataFrame:
    """A store read from a database, where vectors are float32 blobs, with vectors as arrays."""
    return store.withColumn("embedding", vectors.decode_blob("embedding"))


def with_validation(store: DataFrame, dim: int) -> DataFrame:
    """Adds ``reason`` for the vector, an array or a blob, and ``length_issue`` for the recorded length."""
    is_blob = isinstance(store.schema["embedding"].dataType, BinaryType)
    reason = vectors.blob_validation_reason if is_blob else vectors.validation_reason
    return store.withColumns(
        {
            "reason": reason(F.col("embedding"), dim),
            "length_issue": vectors.has_stored_length_issue(F.col("embedding_length"), dim),
        }
    )


def is_issue() -> Column:
    return (F.col("reason") != "valid") | F.col("length_issue")


def dimension(store: DataFrame, expected: int) -> DataFrame:
    """Smallest and largest vector length and how many vectors differ from the expected length."""
    size = F.size("embedding")
    return store.agg(
        F.min(size).alias("min_dim"), F.max(size).alias("max_dim"), F.count_if(size != expected).alias("unexpected")
    )


def progress(items: DataFrame, store: DataFrame, key: str, after: int = 0) -> DataFrame:
    """Totals, distinct finished ids, their difference, and the true number of pending items.

    The difference is wrong where the store has ids without an item, so both figures are given. All of them come
    from one grouping of the ids of both sides.
    """
    wanted = items.select(key, F.lit(1).alias("item"), F.lit(0).alias("stored"))
    done = store.where(F.col(key).isNotNull()).select(key, F.lit(0).alias("item"), F.lit(1).alias("stored"))
    by_id = wanted.union(done).groupBy(key).agg(F.sum("item").alias("items"), F.max("stored").alias("stored"))
    is_open = (F.col("stored") == 0) & (F.col(key) > after)
    return by_id.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("total"),
        F.count_if(F.col("stored") == 1).alias("completed"),
        (F.coalesce(F.sum("items"), F.lit(0)) - F.count_if(F.col("stored") == 1)).alias("pending"),
        F.coalesce(F.sum(F.when(is_open, F.col("items"))), F.lit(0)).alias("truly_pending"),
    )
