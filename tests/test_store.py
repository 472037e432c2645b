import datetime

from helpers import forum, rows_of
from pyspark.sql import functions as F

from forumlens.operators import joins, store as ops
from forumlens.schemas import EMBEDDING_STORE
from forumlens.sources import snapshots

OLD = datetime.datetime(2024, 1, 1)
NEW = datetime.datetime(2024, 2, 1)


def stored(spark, rows):
    """Rows of (vec_id, post_id, thread_id, embedding[, recorded length])."""
    full = [
        (r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else 2, False, 7, OLD) for r in rows
    ]
    return spark.createDataFrame(full, EMBEDDING_STORE)


def changes(spark, rows):
    return spark.createDataFrame(
        [(100 + i, post, None, vector, 2, True, 0, NEW) for i, (post, vector) in enumerate(rows)], EMBEDDING_STORE
    )


def base(spark):
    return stored(
        spark,
        [(0, 1, None, [1.0, 0.0]), (1, 2, None, [0.0, 1.0]), (2, None, 1, [1.0, 1.0]), (3, 99, None, [2.0, 0.0]),
         (4, None, 77, [0.5, 0.5]), (5, None, None, [0.1, 0.2]), (6, 0, 0, [0.1, 0.2]), (7, 3, 2, [0.3, 0.3])],
    )


def test_kind(spark):
    found = dict(rows_of(ops.with_kind(base(spark)), "vec_id", "type"))
    assert found == {0: "post", 1: "post", 2: "thread", 3: "post", 4: "thread", 5: None, 6: None, 7: "post"}


def test_dates(spark):
    dated = ops.with_dates(base(spark), *forum(spark))
    found = dict(rows_of(dated, "vec_id", "date"))
    assert found == {0: 1000, 1: 2000, 2: 3000, 3: None, 4: None, 5: None, 6: None, 7: 3000}


def test_left_join_spreads_missing_keys(spark):
    left = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"))
    right = spark.range(0, 900, 2).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = joins.nullable_key_left_join(left, right, "k", "id")
        assert joined.columns == ["id", "k", "v"]
        assert joined.count() == 900
        assert joined.where("v = 'x'").count() == 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsert_keeps_section_and_time(spark):
    rows = changes(spark, [(2, [9.0, 9.0]), (50, [8.0, 8.0])])
    merged = ops.upsert(base(spark), rows, "post_id")
    found = {r["post_id"]: r for r in merged.where("post_id in (1, 2, 50)").collect()}
    assert (found[2]["embedding"], found[2]["is_truncated"]) == ([9.0, 9.0], True)
    assert (found[2]["section"], found[2]["last_updated"], found[2]["vec_id"]) == (7, OLD, 1)
    assert (found[50]["section"], found[50]["last_updated"]) == (0, NEW)
    assert found[1]["embedding"] == [1.0, 0.0]
    assert merged.count() == base(spark).count() + 1


def test_upsert_twice_is_upsert_once(spark):
    rows = changes(spark, [(2, [9.0, 9.0]), (50, [8.0, 8.0])])
    once = ops.upsert(base(spark), rows, "post_id")
    assert rows_of(ops.upsert(once, rows, "post_id")) == rows_of(once)


def test_repeated_keys_do_not_add_rows(spark):
    rows = changes(spark, [(2, [9.0, 9.0]), (2, [7.0, 7.0]), (50, [8.0, 8.0]), (50, [8.0, 8.0])])
    assert ops.upsert(base(spark), rows, "post_id").count() == base(spark).count() + 1
    assert ops.update_existing(base(spark), rows, "post_id", F.lit(NEW)).count() == base(spark).count()


def test_last_wins_keeps_whole_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, "a"), (2, 5, "b"), (2, None, "c"), (3, 7, "d"), (3, 7, "e")], "id long, version long, text string"
    )
    found = {r["id"]: r["text"] for r in ops.last_wins(rows, "id", "version").collect()}
    assert found[1] == "a" and found[2] == "b" and found[3] in ("d", "e")
    again = {r["id"]: r["text"] for r in ops.last_wins(rows.orderBy(F.desc("text")).repartition(3), "id", "version").collect()}
    assert again == found


def test_half_written_snapshot_is_built_again(spark, tmp_path):
    folder = tmp_path / "index"
    (folder / "_temporary").mkdir(parents=True)
    rows = spark.range(5)
    assert snapshots.build_if_missing(rows, str(folder)).count() == 5
    assert snapshots.build_if_missing(spark.range(9), str(folder)).count() == 5


def test_update_only_touches_known_keys(spark):
    rows = changes(spark, [(2, [9.0, 9.0]), (50, [8.0, 8.0])])
    updated = ops.update_existing(base(spark), rows, "post_id", F.lit(NEW))
    assert updated.count() == base(spark).count()
    row = updated.where("post_id = 2").first()
    assert (row["embedding"], row["section"], row["last_updated"]) == ([9.0, 9.0], 7, NEW)
    assert rows_of(updated.where("not post_id <=> 2")) == rows_of(base(spark).where("not post_id <=> 2"))


def test_delete(spark):
    assert rows_of(ops.delete_kind(base(spark), ops.THREAD), "vec_id") == [(0,), (1,), (3,), (5,)]
    assert ops.delete_kind(base(spark), None).count() == 0


def test_pending_and_progress(spark):
    posts, threads = forum(spark)
    extra = spark.createDataFrame([(0, 1, "x", "zero", 1), (-4, 1, "x", "negative", 1)], posts.schema)
    posts = posts.union(extra)
    assert rows_of(ops.pending(posts, base(spark), "post_id"), "post_id", "message") == [
        (4, "Größe und Länge der Tabelle"), (5, "brown the quick")
    ]
    # 7 posts; stored post ids 1, 2, 99, 0 and 3.
    assert rows_of(ops.progress(posts, base(spark), "post_id"), "total", "completed", "pending", "truly_pending") == [
        (7, 5, 2, 2)
    ]
    assert rows_of(ops.progress(threads, base(spark).where("false"), "thread_id")) == [(0, 3, 3, 3)]
    assert rows_of(ops.progress(threads.where("false"), base(spark).where("false"), "thread_id")) == [(0, 0, 0, 0)]


def test_orphans_and_missing(spark):
    posts, threads = forum(spark)
    assert rows_of(ops.orphans(base(spark), posts, threads), "vec_id", "type") == [(3, "post"), (4, "thread")]
    assert rows_of(ops.missing(base(spark), posts, "post_id")) == [(99,)]


def test_last_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "d")], "k bigint, v int, t string")
    assert rows_of(ops.last_wins(rows, "k", "v"), "k", "v", "t") == [(1, 3, "c"), (2, 1, "d")]


def test_pages_cover_the_table(spark):
    posts, _ = forum(spark)
    last, seen = 0, []
    while page := ops.keyset_page(posts, "post_id", 2, last).collect():
        seen += [r["post_id"] for r in page]
        last = page[-1]["post_id"]
    assert seen == [1, 2, 3, 4, 5]
    assert [r["post_id"] for r in ops.offset_page(posts, "post_id", 2, 3).collect()] == [4, 5]


def test_lookup(spark):
    posts, _ = forum(spark)
    ids = spark.createDataFrame([(2,), (2,), (404,), (None,)], "post_id bigint")
    assert rows_of(ops.lookup(posts, ids, "post_id"), "post_id") == [(2,)]
    assert ops.lookup_one(posts, "post_id", 404).count() == 0
    assert ops.lookup_one(posts, "post_id", 5).first()["message"] == "brown the quick"


def test_dimension(spark):
    rows = stored(spark, [(0, 1, None, [1.0, 0.0]), (1, 2, None, [1.0]), (2, 3, None, None)])
    assert rows_of(ops.dimension(rows, 2), "min_dim", "max_dim", "unexpected") == [(1, 2, 1)]
