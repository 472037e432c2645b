import json

from helpers import forum, rows_of
from pyspark.sql import functions as F

from forumlens.operators import lexical, results
from forumlens.sources import snapshots

HITS = "query_id bigint, rank int, post_id bigint, thread_id bigint"


def details(spark, few=True):
    hits = [
        (1, 1, 5, None), (1, 2, None, 2), (1, 3, 404, None), (1, 4, 1, 3), (1, 5, 0, 1), (1, 6, None, 404),
        (1, 7, None, None), (2, 1, 4, None),
    ]
    return results.resolve_details(spark.createDataFrame(hits, HITS), *forum(spark), few)


def test_details_keep_ranks_and_drop_dangling(spark):
    found = rows_of(details(spark), "query_id", "rank", "type", "post_id", "thread_id", "last_post_date")
    assert found == [
        (1, 1, "post", 5, 2, None),
        (1, 2, "thread", None, 2, 5000),
        (1, 4, "post", 1, 1, None),
        (1, 5, "thread", None, 1, 3000),
        (2, 1, "post", 4, 2, None),
    ]
    first = details(spark).where("query_id = 1 and rank = 4").first()
    assert (first["thread_title"], first["post_date"], first["title"]) == ("Brown fox facts", 1000, None)


def keyword(spark, few=True):
    ranked = spark.createDataFrame(
        [(1, 1, 2.5, 2), (1, 2, 1.5, 5), (3, 1, 1.0, 3)], "query_id bigint, rank int, score double, post_id bigint"
    )
    return lexical.project_hits(ranked, *forum(spark), few)


def test_keyword_fields(spark):
    row = keyword(spark).where("query_id = 1 and rank = 1").first()
    assert row.asDict() == {
        "query_id": 1, "rank": 1, "score": 2.5, "title": "Brown fox facts", "date": 2000, "user": "bob",
        "message": "A quick answer: foxes are quick, quick!", "discussion_id": 1, "node": 1, "post_id": 2,
    }


def test_many_hits_give_the_same_rows(spark):
    assert rows_of(details(spark, few=False)) == rows_of(details(spark))
    assert rows_of(keyword(spark, few=False)) == rows_of(keyword(spark))


def order(fused, query_id):
    rows = fused.where(F.col("query_id") == query_id).orderBy("position").collect()
    return [(r["source_no"], r["rank"]) for r in rows]


def test_fusion_puts_keyword_hits_last(spark):
    fused = results.fuse(details(spark), keyword(spark))
    # Dates 5000, 5000, 1000, 3000 by rank; equal dates keep rank order; keyword hits sort as 0 in score order.
    assert order(fused, 1) == [(0, 1), (0, 2), (0, 5), (0, 4), (1, 1), (1, 2)]
    assert order(fused, 3) == [(1, 1)]


def test_fusion_by_keyword_date(spark):
    fused = results.fuse(details(spark), keyword(spark), use_keyword_date=True)
    assert order(fused, 1) == [(0, 1), (0, 2), (1, 2), (0, 5), (1, 1), (0, 4)]


def test_duplicates_stay(spark):
    fused = results.fuse(details(spark), keyword(spark)).where("query_id = 1 and post_id = 5")
    assert fused.count() == 2


def test_json_document(spark, tmp_path):
    responses = results.combined_json(results.fuse(details(spark), keyword(spark)), lexical.HIT_FIELDS)
    results.write_json(responses, str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 3
    document = max(lines, key=lambda d: len(d["combined_results"]))
    assert [r["type"] for r in document["faiss_results"]] == ["post", "thread", "post", "thread"]
    assert [r["post_id"] for r in document["elasticsearch_results"]] == [2, 5]
    assert "title" not in document["faiss_results"][0] and "message" not in document["faiss_results"][1]
    assert len(document["combined_results"]) == 6


def test_json_roundtrip(spark):
    back = results.results_from_json(results.vector_json(details(spark)))
    names = ["query_id", "type", "post_id", "thread_id", "message", "post_date", "thread_title", "title"]
    assert rows_of(back, *names) == rows_of(details(spark), *names)


def test_rendering_covers_both_kinds(spark):
    found = rows_of(results.render(details(spark)).where("query_id = 1"), "rank", "heading", "posted_at")
    assert found == [
        (1, "Tabellen &amp; &lt;Größen&gt;", "1970-01-01 01:23:20"),
        (2, "Tabellen &amp; &lt;Größen&gt;", "1970-01-01 01:23:20"),
        (4, "Brown fox facts", "1970-01-01 00:16:40"),
        (5, "Brown fox facts", "1970-01-01 00:50:00"),
    ]


def test_message_for_queries_without_hits(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "x < 'y'"), (3, "  ")], "query_id bigint, query string")
    found = results.queries_without_hits(queries, spark.createDataFrame([(1,)], "query_id bigint"))
    assert rows_of(found, "query_id", "message") == [(2, 'No results found for "x &lt; &#039;y&#039;".')]


def test_build_if_missing_keeps_the_first(spark, tmp_path):
    target = str(tmp_path / "index")
    assert snapshots.build_if_missing(spark.range(3), target).count() == 3
    assert snapshots.build_if_missing(spark.range(9), target).count() == 3


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or snapshots.scratch_directory(spark).startswith(shared)
