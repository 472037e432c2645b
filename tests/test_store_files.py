"""Stores, exports and pages on disk: what is written, what is read, and what a stopped writer leaves."""

import os

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from forumlens.operators import ranking, results, store as ops
from forumlens.plans import export, maintenance, registry
from forumlens.schemas import EMBEDDING_STORE
from forumlens.sources import keyed_store, snapshots, tables

NAMES = ("vec_id", "post_id", "thread_id", "embedding", "embedding_length", "section")


@pytest.fixture(scope="module")
def stored(spark, small):
    return tables.embedding_store(spark, small).select(*EMBEDDING_STORE.names)


def changes(spark, ids):
    rows = [(10_000 + i, i, None, [float(i)] * 4, 4, True, 3, None) for i in ids]
    return spark.createDataFrame(rows, EMBEDDING_STORE)


def files(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet") and "/rows/" in f"{d}/"}


def test_a_change_writes_only_the_buckets_of_its_keys(spark, stored, tmp_path):
    folder = str(tmp_path)
    keyed_store.create(stored, folder, 64)
    assert rows_of(keyed_store.read(spark, folder, EMBEDDING_STORE), *NAMES) == rows_of(stored, *NAMES)
    before = files(folder)
    rows = changes(spark, [1, 2, 3, 6, 7, 8, 9001, 9002, 9003, 9003])
    touched = keyed_store.upsert(rows, folder, EMBEDDING_STORE, "post_id")
    written = files(folder) - before
    assert before < files(folder) and len(touched) <= 9
    assert {name.split("bucket=")[1].split("/")[0] for name in written} == {str(b) for b in touched}
    expected = ops.upsert(stored, rows, "post_id")
    assert rows_of(keyed_store.read(spark, folder, EMBEDDING_STORE), *NAMES) == rows_of(expected, *NAMES)
    keyed_store.update(changes(spark, [1, 77_777]), folder, EMBEDDING_STORE, "post_id", F.current_timestamp())
    gone = spark.createDataFrame([(2,), (9001,), (55_555,)], "post_id bigint")
    keyed_store.delete(gone, folder, EMBEDDING_STORE, "post_id")
    left = expected.where("post_id is null or post_id not in (2, 9001)")
    assert rows_of(keyed_store.read(spark, folder, EMBEDDING_STORE), *NAMES) == rows_of(left, *NAMES)


def test_a_stopped_change_leaves_the_store_as_it_was(spark, stored, tmp_path, monkeypatch):
    folder = str(tmp_path)
    keyed_store.create(stored, folder, 8)
    before = rows_of(stored, *NAMES)
    publish = keyed_store.publish
    monkeypatch.setattr(keyed_store, "publish", lambda *args: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        keyed_store.upsert(changes(spark, [1, 9001]), folder, EMBEDDING_STORE, "post_id")
    assert rows_of(keyed_store.read(spark, folder, EMBEDDING_STORE), *NAMES) == before
    monkeypatch.setattr(keyed_store, "publish", publish)
    keyed_store.upsert(changes(spark, [1, 9001]), folder, EMBEDDING_STORE, "post_id")
    assert keyed_store.read(spark, folder, EMBEDDING_STORE).count() == len(before) + 1
    with pytest.raises(ValueError):
        keyed_store.create(stored, folder, 8)


def exchanged(frame):
    return [l for l in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in l]


def test_vectors_of_a_bucketed_store_do_not_move(spark, small, stored, tmp_path):
    posts, threads = tables.posts(spark, small), tables.threads(spark, small)
    bucketed = snapshots.write_bucketed(stored, str(tmp_path / "store"), "vec_id", 4)
    again = snapshots.read_bucketed(spark, str(tmp_path / "store"), EMBEDDING_STORE, "vec_id", 4)
    expected = rows_of(ops.with_dates(stored, posts, threads), "vec_id", "date", "embedding")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for store in (bucketed, again):
            dated = ops.with_dates(store, posts, threads)
            assert not any("embedding" in line for line in exchanged(dated))
            assert rows_of(dated, "vec_id", "date", "embedding") == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_keys_are_found_without_moving_vectors(spark, stored):
    rows = snapshots.materialize(stored.where("post_id is not null"))
    merged = ops.upsert(stored, rows, "post_id")
    assert not any("hashpartitioning" in line and "embedding" in line for line in exchanged(merged))
    twice = snapshots.materialize(rows.union(rows).union(stored.where("post_id is null")))
    found = ops.newest(twice, "post_id", "last_updated")
    assert rows_of(found, "post_id") == rows_of(stored, "post_id")


@pytest.mark.parametrize("ranges", [1, 7])
def test_offset_pages_equal_a_sorted_table(spark, ranges):
    rows = spark.range(500).select((F.col("id") * 37 % 250).alias("k"), F.lit("x").alias("range_no"))
    rows = rows.unionByName(spark.createDataFrame([(None, "n"), (None, "m")], "k bigint, range_no string"))
    listed = [row["k"] for row in rows.orderBy("k").collect()]
    for size, offset in [(10, 0), (3, 1), (10, 251), (40, 240), (5, 497), (5, 600), (1000, 2), (0, 5)]:
        page = ops.offset_page(rows, "k", size, offset, ranges)
        assert [row["k"] for row in page.collect()] == listed[offset : offset + size], (size, offset)
    assert ops.offset_page(rows.where("false"), "k", 5, 0, ranges).count() == 0


def test_a_page_reads_one_range(spark, tmp_path):
    spark.range(10_000).repartition(3).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    page = ops.offset_page(rows, "id", 10, 5_000, 50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    bounds = [int(n) for n in plan.split("GreaterThanOrEqual(id,")[1].split("]")[0].replace("LessThanOrEqual(id,", "").replace(")", "").split(",")]
    assert bounds[0] <= 5_000 <= bounds[1] and bounds[1] - bounds[0] < 1_000
    assert [row["id"] for row in page.collect()] == list(range(5_000, 5_010))


def test_each_limit_moves_its_own_rows(spark):
    hits = snapshots.materialize(spark.range(40_000).select((F.col("id") % 4).alias("query_id"), "id", (F.rand(1) * 30).alias("score")))
    limits = spark.createDataFrame([(0, 10), (1, 1), (2, 3), (3, 2000)], "query_id bigint, max_results int")
    kept = ranking.worth_ranking(hits, limits, "score")
    counts = {row["query_id"]: row["count"] for row in kept.groupBy("query_id").count().collect()}
    assert all(limit <= counts[query] <= limit + 60 for query, limit in ((0, 10), (1, 1), (2, 3), (3, 2000)))
    order = [F.col("score").desc(), F.col("id")]
    whole = ranking.within_own_limit(ranking.top_per_query(hits, order, 2000), limits)
    assert rows_of(ranking.within_own_limit(ranking.top_per_query(kept, order, 2000), limits), "query_id", "rank", "id") == rows_of(whole, "query_id", "rank", "id")
    equal = snapshots.materialize(hits.withColumn("score", F.lit(1.0)))
    assert ranking.worth_ranking(equal, limits, "score").count() == 40_000


def test_export_versions(spark, small, tmp_path, monkeypatch):
    folder, store = str(tmp_path), tables.damaged_store(spark, small)
    half = store.where("vec_id % 2 = 0")
    counts = export.export(half, registry.DIM, folder)
    report = maintenance.export_report(half, registry.DIM).first()
    assert (counts.processed, counts.exported) == (report["processed"], report["exported"])
    export.export(store, registry.DIM, folder)
    expected = rows_of(maintenance.export_rows(store, registry.DIM), "post_id", "embedding_length", "embedding")
    assert rows_of(export.read_export(spark, folder), "post_id", "embedding_length", "embedding") == expected
    assert not any("hashpartitioning" in l and "embedding" in l for l in exchanged(export.read_export(spark, folder)))
    # A run that begins anew and stops before it is published changes nothing.
    publish = export.publish
    monkeypatch.setattr(export, "publish", lambda *args: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        export.export(half, registry.DIM, folder, drop_first=True)
    assert rows_of(export.read_export(spark, folder), "post_id", "embedding_length", "embedding") == expected
    monkeypatch.setattr(export, "publish", publish)
    export.export(half, registry.DIM, folder, drop_first=True)
    expected = rows_of(maintenance.export_rows(half, registry.DIM), "post_id", "embedding_length", "embedding")
    assert rows_of(export.read_export(spark, folder), "post_id", "embedding_length", "embedding") == expected
    bad = ops.with_validation(half, registry.DIM).where("post_id > 0 and reason <> 'valid'")
    assert rows_of(export.read_rejected(spark, folder), "post_id", "reason") == rows_of(bad, "post_id", "reason")


def test_queries_without_results_have_responses(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    hits = spark.createDataFrame([(1, 1, 5, "t")], "query_id bigint, rank int, post_id bigint, title string")
    found = rows_of(results.keyword_json(hits, ("post_id", "title"), queries), "query_id", "response")
    assert found == [(1, '{"elasticsearch_results":[{"post_id":5,"title":"t"}]}'), (2, '{"elasticsearch_results":[]}')]
    details = spark.createDataFrame([], "query_id bigint, rank int, type string, post_id bigint, thread_id bigint, message string, post_date bigint, thread_title string, title string, last_post_date bigint")
    assert rows_of(results.vector_json(details, queries), "response") == [('{"faiss_results":[]}',)] * 2
