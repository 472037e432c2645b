import numpy as np
from helpers import forum, rows_of
from pyspark.sql import functions as F
from test_store import NEW, base, stored

from forumlens.operators import store as ops
from forumlens.operators.embedding import hashed_embedder, model_embedder
from forumlens.plans import maintenance, registry, search
from forumlens.sources import tables

DIM = 16


def now():
    return F.lit(NEW)


def test_backfill_leaves_nothing_pending(spark):
    posts, threads = forum(spark)
    args = (hashed_embedder(DIM), DIM, now())
    store = maintenance.backfilled_store(posts, base(spark), ops.POST, *args)
    assert ops.pending(posts, store, "post_id").count() == 0
    again = maintenance.backfilled_store(posts, store, ops.POST, *args)
    assert again.count() == store.count()
    both = maintenance.backfilled_store(threads, store, ops.THREAD, *args)
    assert ops.pending(threads, both, "thread_id").count() == 0


def test_texts_without_words_go_to_quarantine(spark):
    posts, _ = forum(spark)
    odd = spark.createDataFrame([(9, 1, "x", "?!", 1), (10, 1, "x", None, 1)], posts.schema)
    rows = maintenance.embed_items(posts.union(odd), ops.POST, hashed_embedder(DIM), DIM, now())
    assert rows_of(maintenance.quarantined(rows), "post_id", "reason") == [(10, "none"), (9, "none")]
    assert maintenance.accepted(rows).count() == 5
    assert "reason" not in maintenance.accepted(rows).columns


def test_a_model_runs_once_per_text(spark, tmp_path):
    """Filtering and validating must not repeat the embedding call."""
    log = str(tmp_path / "calls")

    def load():
        def embed(texts):
            with open(log, "a") as out:
                out.writelines("x\n" for _ in texts)
            return np.ones((len(texts), DIM))

        return embed

    posts, _ = forum(spark)
    rows = maintenance.embed_items(posts, ops.POST, model_embedder(load), DIM, now())
    assert len(maintenance.accepted(rows).collect()) == 5
    with open(log) as calls:
        assert len(calls.readlines()) == 5


def test_truncation_flag_comes_from_the_whole_text(spark):
    posts, _ = forum(spark)
    rows = maintenance.embed_items(posts, ops.POST, hashed_embedder(DIM), DIM, now(), max_tokens=5)
    assert dict(rows_of(rows, "post_id", "is_truncated")) == {1: True, 2: True, 3: False, 4: False, 5: False}
    short = maintenance.embed_items(
        posts.withColumn("message", F.lit("the quick brown fox jumps")), ops.POST, hashed_embedder(DIM), DIM, now()
    )
    first = rows.where("post_id = 1").first()["embedding"]
    assert first == short.where("post_id = 1").first()["embedding"]


def damaged(spark):
    nan = float("nan")
    return stored(
        spark,
        [(0, 1, None, [nan] * DIM, DIM), (1, 2, None, [0.5] * DIM, 15), (2, None, 1, None, DIM),
         (3, 99, None, None, DIM), (4, 3, None, [0.5] * DIM, DIM), (5, 4, None, [200.0] * DIM, DIM)],
    )


def test_check_counts_each_reason(spark):
    found = rows_of(maintenance.check(damaged(spark), DIM), "reason", "vectors", "issues")
    assert found == [("extreme", 1, 1), ("none", 2, 2), ("nonfinite", 1, 1), ("valid", 2, 1)]
    threads = maintenance.check(damaged(spark), DIM, ops.THREAD)
    assert rows_of(threads, "reason", "vectors", "issues") == [("none", 1, 1)]


def test_repair_fixes_what_has_a_source(spark):
    posts, threads = forum(spark)
    assert rows_of(maintenance.repair_report(damaged(spark), posts, ops.POST, DIM), "reason", "repaired") == [
        ("extreme", 1), ("nonfinite", 1), ("valid", 1)
    ]
    args = (hashed_embedder(DIM), DIM, now())
    fixed = maintenance.repair(damaged(spark), posts, ops.POST, *args)
    assert maintenance.repair_candidates(fixed, posts, ops.POST, DIM).count() == 0
    assert rows_of(fixed.where("last_updated = timestamp'2024-02-01'"), "post_id") == [(1,), (2,), (4,)]
    both = maintenance.repair(fixed, threads, ops.THREAD, *args)
    left = ops.with_validation(both, DIM).where(ops.is_issue())
    assert rows_of(left, "post_id") == [(99,)]


def test_rebuild_by_kind(spark):
    posts, threads = forum(spark)
    args = (hashed_embedder(DIM), DIM, now())
    by_thread = maintenance.rebuild(threads, damaged(spark), ops.THREAD, *args)
    assert rows_of(by_thread.where("thread_id is not null"), "thread_id") == [(1,), (2,), (3,)]
    assert by_thread.where("post_id is not null").count() == 5
    everything = maintenance.rebuild(posts, damaged(spark), ops.POST, *args, every_kind=True)
    assert rows_of(everything, "post_id", "thread_id") == [(i, None) for i in range(1, 6)]


def test_refresh_upserts_named_posts(spark):
    posts, _ = forum(spark)
    ids = spark.createDataFrame([(1,), (5,), (404,)], "post_id bigint")
    fresh = maintenance.refresh(ids, posts, damaged(spark), ops.POST, hashed_embedder(DIM), DIM, now())
    assert fresh.count() == 7
    reasons = dict(rows_of(ops.with_validation(fresh, DIM).where("post_id is not null"), "post_id", "reason"))
    assert reasons == {1: "valid", 2: "valid", 3: "valid", 4: "extreme", 5: "valid", 99: "none"}


def test_export_validates_and_keeps_the_last(spark):
    twice = damaged(spark).union(stored(spark, [(9, 3, None, [0.25] * DIM, DIM), (10, -1, None, [0.25] * DIM, DIM)]))
    rows = maintenance.export_rows(twice, DIM).orderBy("post_id").collect()
    assert [(r["post_id"], r["embedding"][0], r["embedding_length"]) for r in rows] == [(2, 0.5, 15), (3, 0.25, DIM)]
    report = maintenance.export_report(twice, DIM)
    assert rows_of(report, "processed", "exported") == [(6, 3)]


def test_export_does_not_shuffle_vectors(spark):
    text = maintenance.export_rows(damaged(spark), DIM)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_export_of_a_post_with_a_third_of_all_rows(spark):
    rows = [(i, 7 if i % 3 == 0 else i, None, [float(i % 5)] * DIM, DIM) for i in range(1, 301)]
    found = maintenance.export_rows(stored(spark, rows), DIM).collect()
    by_post = {}
    for vec_id, post_id, *_ in rows:
        by_post[post_id] = vec_id
    assert sorted((r["post_id"], r["embedding"][0]) for r in found) == sorted(
        (post_id, float(vec_id % 5)) for post_id, vec_id in by_post.items()
    )


def test_vector_search_finds_the_text_itself(spark):
    posts, threads = forum(spark)
    rows = maintenance.embed_items(posts, ops.POST, hashed_embedder(64), 64, now())
    queries = spark.createDataFrame(
        [(1, "brown the quick", 1), (2, "nothing to see here", None), (3, " ", 5)],
        "query_id bigint, query string, max_results int",
    )
    found = search.vector_search(queries, maintenance.accepted(rows), posts, threads, hashed_embedder(64))
    first = rows_of(found.where("rank = 1"), "query_id", "post_id")
    assert first == [(1, 5), (2, 3)]
    assert found.where("query_id = 1").count() == 1
    assert found.where("query_id = 2").count() == 5


def test_saved_index_in_combined_search(spark, small, tmp_path):
    from forumlens.operators import keyword_index

    index = keyword_index.add(tables.posts(spark, small), tables.threads(spark, small), str(tmp_path / "index"), buckets=8, span=32)
    args = (
        tables.keyword_queries(spark, small), registry.text_store(spark, small), tables.posts(spark, small),
        tables.threads(spark, small), registry._embedder(), registry._origin(),
    )
    names = ["query_id", "position", "source_no", "rank", "post_id", "thread_id"]
    assert rows_of(search.combined_search(*args, saved=index), *names) == rows_of(search.combined_search(*args), *names)


def test_blob_stores_are_checked_and_decoded(spark):
    from forumlens.functions import vectors

    blobs = damaged(spark).withColumn("embedding", vectors.encode_blob("embedding"))
    broken = F.when(F.col("vec_id") == 4, F.concat("embedding", F.lit(b"x"))).otherwise(F.col("embedding"))
    found = maintenance.check(blobs.withColumn("embedding", broken), DIM)
    assert dict(rows_of(found, "reason", "vectors")) == {
        "buffer": 1, "extreme": 1, "none": 2, "nonfinite": 1, "valid": 1
    }
    assert rows_of(ops.decoded(blobs)) == rows_of(damaged(spark))
