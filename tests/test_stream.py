from helpers import rows_of
from pyspark.sql import functions as F

from forumlens.operators import store as ops
from forumlens.operators.embedding import hashed_embedder
from forumlens.plans import maintenance, registry
from forumlens.schemas import EMBEDDING_STORE, POSTS
from forumlens.sources import snapshots, tables
from forumlens.streaming import incremental

DIM = 64


def run_backfill(spark, root):
    stream = incremental.item_stream(spark, f"{root}/source", POSTS, files_per_batch=2)
    query = incremental.start_backfill(
        stream, f"{root}/store", f"{root}/quarantine", f"{root}/checkpoint", ops.POST, hashed_embedder(DIM), DIM
    )
    query.awaitTermination()


def ids_and_vectors(rows):
    return rows_of(rows, "post_id", "embedding_length", "is_truncated", "embedding")


def test_stream_equals_batch_and_runs_again(spark, small, tmp_path):
    posts = tables.posts(spark, small).select(*POSTS.names)
    posts.where("post_id % 3 > 0").repartition(5, "post_id").write.parquet(f"{tmp_path}/source")
    run_backfill(spark, tmp_path)
    run_backfill(spark, tmp_path)
    # Later files hold new posts and some that were there before.
    posts.where("post_id % 2 = 0").coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    run_backfill(spark, tmp_path)
    stored = snapshots.read_batches(spark, f"{tmp_path}/store", EMBEDDING_STORE)
    assert stored.select("batch_id").distinct().count() >= 2
    source = posts.where("post_id % 3 > 0 or post_id % 2 = 0")
    batch = maintenance.accepted(
        maintenance.embed_items(source, ops.POST, hashed_embedder(DIM), DIM, F.current_timestamp())
    )
    assert ids_and_vectors(stored) == ids_and_vectors(batch)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    target = f"{tmp_path}/store"
    rows = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1)], incremental.VECTOR_EXPORT)
    snapshots.write_batch(rows, target, 0)
    snapshots.write_batch(rows, target, 1)
    snapshots.write_batch(rows, target, 1)
    assert snapshots.read_batches(spark, target, incremental.VECTOR_EXPORT).count() == 4
    assert snapshots.read_batches(spark, target, incremental.VECTOR_EXPORT, before=1).count() == 2
    assert incremental.read_export(spark, target).count() == 2


def test_export_stream_equals_batch(spark, small, tmp_path):
    store = tables.damaged_store(spark, small).select(*EMBEDDING_STORE.names)
    store.repartition(3, "vec_id").write.parquet(f"{tmp_path}/source")
    stream = incremental.item_stream(spark, f"{tmp_path}/source", EMBEDDING_STORE, files_per_batch=1)
    query = incremental.start_export(stream, f"{tmp_path}/export", f"{tmp_path}/checkpoint", registry.DIM)
    query.awaitTermination()
    found = rows_of(incremental.read_export(spark, f"{tmp_path}/export"), "post_id", "embedding_length", "embedding")
    expected = rows_of(maintenance.export_rows(store, registry.DIM), "post_id", "embedding_length", "embedding")
    assert found == expected and found


def test_backfill_skips_what_another_store_has(spark, small, tmp_path):
    threads = tables.threads(spark, small)
    threads.write.parquet(f"{tmp_path}/source")
    existing = tables.embedding_store(spark, small).where("thread_id <= 4")
    query = incremental.start_backfill(
        incremental.item_stream(spark, f"{tmp_path}/source", threads.schema),
        f"{tmp_path}/store", f"{tmp_path}/quarantine", f"{tmp_path}/checkpoint",
        ops.THREAD, hashed_embedder(DIM), DIM, existing,
    )
    query.awaitTermination()
    stored = snapshots.read_batches(spark, f"{tmp_path}/store", EMBEDDING_STORE)
    expected = [(r[0],) for r in threads.where("thread_id > 4").select("thread_id").collect()]
    assert rows_of(stored, "thread_id") == sorted(expected, key=repr)
