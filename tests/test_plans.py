"""Shapes of physical plans that must hold at any size."""

import pytest

from forumlens.operators import store as ops
from forumlens.plans import maintenance, registry
from forumlens.sources import tables


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_no_cross_join(spark, small, name):
    text = plan(registry.all_queries()[name](spark, small))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_ranking_limits_before_the_shuffle(spark, small):
    text = plan(registry._stored_hits(spark, small))
    assert text.count("WindowGroupLimit") == 2


def test_vectors_do_not_shuffle_in_search(spark, small):
    for line in plan(registry._stored_hits(spark, small)).splitlines():
        assert not ("Exchange" in line and "embedding" in line)


def test_pending_is_an_anti_join_on_ids(spark, small):
    posts, store = tables.posts(spark, small), tables.embedding_store(spark, small)
    ids = plan(ops.pending_ids(posts, store, "post_id"))
    assert "LeftAnti" in ids and "text" not in ids
    found = plan(ops.pending(posts, store, "post_id"))
    assert "LeftSemi" in found and "hashpartitioning" not in found


def test_small_repairs_do_not_shuffle_the_store(spark, small):
    repaired = maintenance.repair(
        tables.damaged_store(spark, small), tables.posts(spark, small), ops.POST,
        registry._embedder(), registry.DIM, registry._now(),
    )
    text = plan(repaired)
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_columns_are_pruned(spark, small):
    text = plan(tables.embedding_store(spark, small).select("vec_id", "post_id"))
    assert "ReadSchema: struct<vec_id:bigint>" in text


def test_point_filter_reaches_the_scan(spark, small):
    rows = tables.read_parquet(spark, small, "documents")
    assert "EqualTo(doc_id,7)" in plan(ops.lookup_one(rows, "doc_id", 7))


def test_embedding_runs_once(spark, small):
    posts = tables.posts(spark, small)
    rows = maintenance.embed_items(posts, ops.POST, registry._embedder(), registry.DIM, registry._now())
    assert plan(maintenance.accepted(rows)).count("ArrowEvalPython") == 1
