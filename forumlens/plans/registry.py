"""Checked queries: each runs one operator or job over the whole tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlens.functions import scoring, text, vectors
from forumlens.operators import clauses, embedding, keyword_index, knn, lexical, results, store as ops
from forumlens.operators.ranking import batch_figures, with_result_limit
from forumlens.plans import export, maintenance, search
from forumlens.schemas import EMBEDDING_STORE
from forumlens.sources import keyed_store, snapshots, tables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the checked queries.
DIM = tables.VIEW_DIM
RECENCY_ORIGIN = 1707000000
NOW = "2024-02-01 00:00:00"
TRUNCATE_AT = 1000
BUCKETS, SPAN = 16, 256
# Result limits of requests whose results are fused.
FUSED_LIMITS = (None, 1, 3)

_QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    _QUERIES[run.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _embedder() -> embedding.Embedder:
    return embedding.hashed_embedder(DIM)


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _origin() -> Column:
    return F.lit(RECENCY_ORIGIN)


def _total(vector: str = "embedding") -> Column:
    """Order-sensitive digest of a vector: elements weighted by their position."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 6).alias("total")


def _store_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "post_id",
        "thread_id",
        "embedding_length",
        "is_truncated",
        "section",
        F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        _total(),
    )


def _elements(rows: DataFrame, key: str) -> DataFrame:
    listed = rows.select(key, F.posexplode("embedding").alias("position", "value"))
    return listed.select(key, "position", F.round(F.col("value").cast("double"), 6).alias("value"))


def _embedded_posts(spark: SparkSession, directory: str) -> DataFrame:
    posts = tables.posts(spark, directory)
    return maintenance.accepted(maintenance.embed_items(posts, ops.POST, _embedder(), DIM, _now()))


def _embedded_threads(spark: SparkSession, directory: str) -> DataFrame:
    threads = tables.threads(spark, directory)
    return maintenance.accepted(maintenance.embed_items(threads, ops.THREAD, _embedder(), DIM, _now()))


def text_store(spark: SparkSession, directory: str) -> DataFrame:
    """The store made from every post and every thread title."""
    return _embedded_posts(spark, directory).unionByName(_embedded_threads(spark, directory))


def _stored_hits(spark: SparkSession, directory: str) -> DataFrame:
    queries = tables.vector_queries(spark, directory)
    return knn.nearest(queries, tables.embedding_store(spark, directory), 10)


def _details(spark: SparkSession, directory: str) -> DataFrame:
    hits = snapshots.materialize(_stored_hits(spark, directory))
    few = batch_figures(tables.vector_queries(spark, directory)).few_hits
    return results.resolve_details(hits, tables.posts(spark, directory), tables.threads(spark, directory), few)


def _matches(spark: SparkSession, directory: str, asked: DataFrame) -> DataFrame:
    units = clauses.Units(asked)
    index = clauses.index_for(tables.posts(spark, directory), tables.threads(spark, directory), units)
    return clauses.matches(index, units)


def _keyword_hits(spark: SparkSession, directory: str, queries: DataFrame) -> DataFrame:
    return search.keyword_hits(queries, tables.posts(spark, directory), tables.threads(spark, directory), _origin())


def _hits(spark: SparkSession, directory: str, queries: DataFrame, saved=None, asked: DataFrame | None = None) -> DataFrame:
    """Ranked hits of a batch with their output fields."""
    posts, threads = tables.posts(spark, directory), tables.threads(spark, directory)
    hits = search.keyword_search(queries, posts, threads, _origin(), saved, asked=asked)
    return hits.withColumn("score", F.round("score", 6))


def _saved_index(spark: SparkSession, directory: str) -> keyword_index.KeywordIndex:
    folder = snapshots.scratch_directory(spark)
    return keyword_index.add(tables.posts(spark, directory), tables.threads(spark, directory), folder, BUCKETS, SPAN)


# Sources and sinks


@query
def store_scan(spark: SparkSession, directory: str) -> DataFrame:
    return tables.embedding_store(spark, directory).select(
        "vec_id", "post_id", "thread_id", F.size("embedding").alias("dim"), _total()
    )


@query
def store_with_dates(spark: SparkSession, directory: str) -> DataFrame:
    # The digest stands in for the vector, so that the joins move a number and not the vector.
    store = tables.embedding_store(spark, directory).select("vec_id", "post_id", "thread_id", _total())
    return ops.with_dates(store, tables.posts(spark, directory), tables.threads(spark, directory))


@query
def store_with_dates_bucketed(spark: SparkSession, directory: str) -> DataFrame:
    """The same with vectors, which stay in their buckets."""
    rows = tables.embedding_store(spark, directory)
    store = snapshots.write_bucketed(rows, snapshots.scratch_directory(spark), "vec_id", BUCKETS)
    dated = ops.with_dates(store, tables.posts(spark, directory), tables.threads(spark, directory))
    return dated.select("vec_id", "post_id", "thread_id", "date", _total())


@query
def point_lookup(spark: SparkSession, directory: str) -> DataFrame:
    store = tables.embedding_store(spark, directory)
    found_posts = ops.lookup(tables.posts(spark, directory), store, "post_id")
    found_threads = ops.lookup(tables.threads(spark, directory), store, "thread_id")
    return found_posts.select(
        F.lit(ops.POST).alias("type"), F.col("post_id").alias("id"), F.col("message").alias("content")
    ).union(found_threads.select(F.lit(ops.THREAD), "thread_id", "title"))


@query
def keyset_page(spark: SparkSession, directory: str) -> DataFrame:
    return ops.keyset_page(tables.posts(spark, directory), "post_id", 100, after=200).select("post_id", "message")


@query
def offset_page(spark: SparkSession, directory: str) -> DataFrame:
    page = ops.offset_page(tables.embedding_store(spark, directory), "vec_id", 100, offset=200)
    return page.select("vec_id", "post_id", "thread_id", "embedding_length")


@query
def store_upsert(spark: SparkSession, directory: str) -> DataFrame:
    rows = snapshots.materialize(_embedded_posts(spark, directory))
    return _store_rows(ops.upsert(tables.embedding_store(spark, directory), rows, "post_id"))


@query
def store_upsert_keyed(spark: SparkSession, directory: str) -> DataFrame:
    """The same in a store on disk, of which only the buckets of the new rows are written."""
    folder, schema = snapshots.scratch_directory(spark), EMBEDDING_STORE
    keyed_store.create(tables.embedding_store(spark, directory).select(*schema.names), folder, BUCKETS)
    keyed_store.upsert(_embedded_posts(spark, directory), folder, schema, "post_id")
    return _store_rows(keyed_store.read(spark, folder, schema))


@query
def store_update(spark: SparkSession, directory: str) -> DataFrame:
    rows = snapshots.materialize(_embedded_posts(spark, directory))
    return _store_rows(ops.update_existing(tables.embedding_store(spark, directory), rows, "post_id", _now()))


@query
def store_delete_kind(spark: SparkSession, directory: str) -> DataFrame:
    kept = ops.delete_kind(tables.embedding_store(spark, directory), ops.THREAD)
    return kept.select("vec_id", "post_id", "thread_id")


@query
def vector_export(spark: SparkSession, directory: str) -> DataFrame:
    exported = maintenance.export_rows(tables.damaged_store(spark, directory), DIM)
    return exported.select("post_id", "embedding_length", _total())


@query
def vector_export_versions(spark: SparkSession, directory: str) -> DataFrame:
    """The export read back after a first run over half of the store and a second over all of it."""
    store, folder = tables.damaged_store(spark, directory), snapshots.scratch_directory(spark)
    export.export(store.where(F.col("vec_id") % 2 == 0), DIM, folder, drop_first=True)
    export.export(store, DIM, folder)
    return export.read_export(spark, folder).select("post_id", "embedding_length", _total())


@query
def index_build_if_missing(spark: SparkSession, directory: str) -> DataFrame:
    target = snapshots.scratch_directory(spark)
    snapshots.build_if_missing(tables.embedding_store(spark, directory), target)
    again = snapshots.build_if_missing(tables.damaged_store(spark, directory), target)
    return again.select("vec_id", "post_id", "thread_id", "embedding_length", _total())


@query
def query_batch(spark: SparkSession, directory: str) -> DataFrame:
    queries = with_result_limit(tables.keyword_queries(spark, directory))
    return queries.where(~text.is_blank(F.col("query")))


@query
def results_json(spark: SparkSession, directory: str) -> DataFrame:
    return results.vector_json(_details(spark, directory), tables.vector_queries(spark, directory))


@query
def keyword_json(spark: SparkSession, directory: str) -> DataFrame:
    queries = tables.keyword_queries(spark, directory, FUSED_LIMITS)
    hits = search.keyword_search(queries, tables.posts(spark, directory), tables.threads(spark, directory), _origin())
    return results.keyword_json(hits, lexical.HIT_FIELDS, queries.where(~text.is_blank(F.col("query"))))


@query
def results_from_json(spark: SparkSession, directory: str) -> DataFrame:
    return results.results_from_json(results_json(spark, directory))


@query
def combined_json(spark: SparkSession, directory: str) -> DataFrame:
    asked = tables.keyword_queries(spark, directory, FUSED_LIMITS).where(~text.is_blank(F.col("query")))
    return results.combined_json(combined_search(spark, directory), lexical.HIT_FIELDS, asked)


# Projections, filters and predicates


@query
def lexical_project(spark: SparkSession, directory: str) -> DataFrame:
    return lexical_search(spark, directory).drop("score")


@query
def store_kind(spark: SparkSession, directory: str) -> DataFrame:
    return ops.with_kind(tables.embedding_store(spark, directory)).select("vec_id", "type")


@query
def in_hits_semi(spark: SparkSession, directory: str) -> DataFrame:
    hits = snapshots.materialize(_stored_hits(spark, directory))
    found = ops.lookup(tables.posts(spark, directory), hits, "post_id")
    return found.select("post_id", "thread_id", "message")


@query
def missing_ids(spark: SparkSession, directory: str) -> DataFrame:
    store = tables.embedding_store(spark, directory)
    return ops.missing(store, tables.posts(spark, directory), "post_id")


@query
def validate_vectors(spark: SparkSession, directory: str) -> DataFrame:
    checked = ops.with_validation(tables.damaged_store(spark, directory), DIM)
    return checked.select("vec_id", "reason")


@query
def stored_length_issues(spark: SparkSession, directory: str) -> DataFrame:
    checked = ops.with_validation(tables.damaged_store(spark, directory), DIM)
    return checked.where("length_issue").select("vec_id", "embedding_length", "reason")


# Joins


@query
def pending_posts(spark: SparkSession, directory: str) -> DataFrame:
    items = ops.pending(tables.posts(spark, directory), tables.embedding_store(spark, directory), "post_id")
    return items.select("post_id", "message")


@query
def pending_threads(spark: SparkSession, directory: str) -> DataFrame:
    store = tables.embedding_store(spark, directory)
    return ops.pending(tables.threads(spark, directory), store, "thread_id").select("thread_id", "title")


@query
def post_details(spark: SparkSession, directory: str) -> DataFrame:
    return results.post_details(tables.posts(spark, directory), tables.threads(spark, directory))


@query
def repair_candidates(spark: SparkSession, directory: str) -> DataFrame:
    return maintenance.repair_candidates(
        tables.damaged_store(spark, directory), tables.posts(spark, directory), ops.POST, DIM
    )


@query
def knn_l2_topk(spark: SparkSession, directory: str) -> DataFrame:
    return _stored_hits(spark, directory).withColumn("distance", F.round("distance", 6))


@query
def knn_cosine_topk(spark: SparkSession, directory: str) -> DataFrame:
    queries = tables.vector_queries(spark, directory)
    hits = knn.nearest(queries, tables.embedding_store(spark, directory), 5, knn.COSINE)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query
def orphan_vectors(spark: SparkSession, directory: str) -> DataFrame:
    lost = ops.orphans(
        tables.embedding_store(spark, directory), tables.posts(spark, directory), tables.threads(spark, directory)
    )
    return lost.select("vec_id", "type", "post_id", "thread_id")


@query
def resolve_details(spark: SparkSession, directory: str) -> DataFrame:
    return _details(spark, directory)


# Aggregations


@query
def store_counts(spark: SparkSession, directory: str) -> DataFrame:
    return tables.embedding_store(spark, directory).agg(
        F.count("*").alias("vectors"),
        F.count("post_id").alias("post_vectors"),
        F.count("thread_id").alias("thread_vectors"),
    )


@query
def progress_posts(spark: SparkSession, directory: str) -> DataFrame:
    return ops.progress(tables.posts(spark, directory), tables.embedding_store(spark, directory), "post_id")


@query
def progress_threads(spark: SparkSession, directory: str) -> DataFrame:
    return ops.progress(tables.threads(spark, directory), tables.embedding_store(spark, directory), "thread_id")


@query
def check_report(spark: SparkSession, directory: str) -> DataFrame:
    return maintenance.check(tables.damaged_store(spark, directory), DIM)


@query
def repair_report(spark: SparkSession, directory: str) -> DataFrame:
    return maintenance.repair_report(
        tables.damaged_store(spark, directory), tables.posts(spark, directory), ops.POST, DIM
    )


@query
def export_report(spark: SparkSession, directory: str) -> DataFrame:
    return maintenance.export_report(tables.damaged_store(spark, directory), DIM)


@query
def lexical_stats(spark: SparkSession, directory: str) -> DataFrame:
    lengths = keyword_index.field_lengths(tables.posts(spark, directory), tables.threads(spark, directory))
    return keyword_index.corpus_figures(lengths).select(
        "posts",
        "title_words",
        "message_words",
        F.round(F.col("title_words") / F.col("posts"), 6).alias("average_title"),
        F.round(F.col("message_words") / F.col("posts"), 6).alias("average_message"),
    )


@query
def lexical_doc_freq(spark: SparkSession, directory: str) -> DataFrame:
    postings = keyword_index.field_postings(tables.posts(spark, directory), tables.threads(spark, directory))
    return keyword_index.term_figures(postings.groupBy("term", "field").agg(F.count("*").alias("posts")))


@query
def store_dimension(spark: SparkSession, directory: str) -> DataFrame:
    return ops.dimension(tables.damaged_store(spark, directory), DIM)


@query
def distinct_embedded_ids(spark: SparkSession, directory: str) -> DataFrame:
    return ops.embedded_ids(tables.embedding_store(spark, directory), "post_id")


@query
def dedup_last_wins(spark: SparkSession, directory: str) -> DataFrame:
    return ops.last_wins(tables.posts(spark, directory), "thread_id", "post_date")


# Vector and text functions


@query
def blob_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    blobs = tables.embedding_store(spark, directory).select(
        "vec_id", vectors.encode_blob("embedding").alias("blob")
    )
    decoded = blobs.select("vec_id", F.length("blob").alias("bytes"), vectors.decode_blob("blob").alias("embedding"))
    return decoded.select("vec_id", "bytes", _total())


@query
def vector_norms(spark: SparkSession, directory: str) -> DataFrame:
    vector = F.col("embedding")
    return tables.embedding_store(spark, directory).select(
        "vec_id",
        F.round(vectors.dot(vector, F.reverse(vector)), 6).alias("dot_with_reverse"),
        F.round(vectors.squared_l2(vector, F.reverse(vector)), 6).alias("distance_to_reverse"),
        F.round(vectors.cosine(vector, F.reverse(vector)), 6).alias("cosine_with_reverse"),
        F.round(vectors.norm(vector), 6).alias("norm"),
    )


@query
def vector_maxabs(spark: SparkSession, directory: str) -> DataFrame:
    vector = F.col("embedding")
    finite = vectors.all_finite(vector)
    return tables.damaged_store(spark, directory).select(
        "vec_id",
        finite.alias("finite"),
        F.round(F.when(finite, vectors.max_abs(vector)).cast("double"), 6).alias("max_abs"),
    )


@query
def token_counts(spark: SparkSession, directory: str) -> DataFrame:
    documents = tables.read_parquet(spark, directory, "documents")
    return documents.select("doc_id", text.token_count(F.col("text")).cast("bigint").alias("tokens"))


@query
def truncate_text(spark: SparkSession, directory: str) -> DataFrame:
    flagged = tables.read_parquet(spark, directory, "documents").select(
        "doc_id", "text", text.is_over_limit(F.col("text"), TRUNCATE_AT).alias("is_truncated")
    )
    kept = text.truncate_tokens(F.col("text"), F.col("is_truncated"), TRUNCATE_AT)
    cut = flagged.select("doc_id", "is_truncated", kept.alias("kept"))
    return cut.select("doc_id", "is_truncated", F.length("kept").alias("characters"), F.md5("kept").alias("digest"))


@query
def html_escape(spark: SparkSession, directory: str) -> DataFrame:
    pages = tables.read_parquet(spark, directory, "pages")
    return pages.select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query
def recency_decay(spark: SparkSession, directory: str) -> DataFrame:
    return tables.posts(spark, directory).select(
        "post_id", F.round(scoring.recency(F.col("post_date"), _origin()), 6).alias("decay")
    )


# Keyword search


@query
def lexical_match_and(spark: SparkSession, directory: str) -> DataFrame:
    return _matches(spark, directory, tables.word_clauses(spark, directory, ("must", "must"))).select("query_id", "post_id")


@query
def lexical_match_or(spark: SparkSession, directory: str) -> DataFrame:
    return _matches(spark, directory, tables.passage_clauses(spark, directory)).select("query_id", "post_id")


@query
def lexical_match_not(spark: SparkSession, directory: str) -> DataFrame:
    asked = tables.word_clauses(spark, directory, ("must", "must_not"))
    return _matches(spark, directory, asked).select("query_id", "post_id")


@query
def lexical_match_phrase(spark: SparkSession, directory: str) -> DataFrame:
    return _matches(spark, directory, tables.phrase_clauses(spark, directory)).select("query_id", "post_id")


@query
def lexical_match_prefix(spark: SparkSession, directory: str) -> DataFrame:
    return _matches(spark, directory, tables.prefix_clauses(spark, directory)).select("query_id", "post_id")


@query
def lexical_score(spark: SparkSession, directory: str) -> DataFrame:
    matches = _matches(spark, directory, clauses.must_clauses(tables.keyword_queries(spark, directory)))
    return matches.select("query_id", "post_id", F.round("relevance", 6).alias("relevance"))


@query
def lexical_topk(spark: SparkSession, directory: str) -> DataFrame:
    ranked = _keyword_hits(spark, directory, tables.keyword_queries(spark, directory))
    return ranked.withColumn("score", F.round("score", 6))


@query
def lexical_search(spark: SparkSession, directory: str) -> DataFrame:
    return _hits(spark, directory, tables.keyword_queries(spark, directory))


@query
def lexical_search_saved(spark: SparkSession, directory: str) -> DataFrame:
    return _hits(spark, directory, tables.keyword_queries(spark, directory), _saved_index(spark, directory))


@query
def lexical_search_clauses(spark: SparkSession, directory: str) -> DataFrame:
    asked = tables.mixed_clauses(spark, directory)
    return _hits(spark, directory, tables.mixed_queries(spark, directory), asked=asked)


@query
def lexical_search_clauses_saved(spark: SparkSession, directory: str) -> DataFrame:
    asked, index = tables.mixed_clauses(spark, directory), _saved_index(spark, directory)
    return _hits(spark, directory, tables.mixed_queries(spark, directory), index, asked)


@query
def lexical_search_phrases_saved(spark: SparkSession, directory: str) -> DataFrame:
    asked, index = tables.phrase_clauses(spark, directory), _saved_index(spark, directory)
    return _hits(spark, directory, asked.select("query_id"), index, asked)


@query
def lexical_search_segments(spark: SparkSession, directory: str) -> DataFrame:
    """Search of an index to which posts were added three times, the last ones twice, and from which some were deleted."""
    posts, threads = tables.posts(spark, directory), tables.threads(spark, directory)
    folder = snapshots.scratch_directory(spark)
    for part in range(3):
        keyword_index.add(posts.where(F.col("post_id") % 3 == part), threads, folder, BUCKETS, SPAN)
    keyword_index.add(posts.where(F.col("post_id") % 21 == 2), threads, folder)
    index = keyword_index.delete(spark, folder, posts.where(F.col("post_id") % 10 == 0).select("post_id"))
    return _hits(spark, directory, tables.keyword_queries(spark, directory), index)


@query
def queries_without_hits(spark: SparkSession, directory: str) -> DataFrame:
    # One result of each request tells whether there is any.
    queries = tables.keyword_queries(spark, directory)
    return results.queries_without_hits(queries, _keyword_hits(spark, directory, queries.withColumn("max_results", F.lit(1))))


# Embedding


@query
def embed_posts(spark: SparkSession, directory: str) -> DataFrame:
    return _elements(_embedded_posts(spark, directory), "post_id")


@query
def embed_threads(spark: SparkSession, directory: str) -> DataFrame:
    return _elements(_embedded_threads(spark, directory), "thread_id")


@query
def embed_queries(spark: SparkSession, directory: str) -> DataFrame:
    return _elements(embedding.embed_queries(tables.text_queries(spark, directory), _embedder()), "query_id")


# Search jobs


@query
def vector_search(spark: SparkSession, directory: str) -> DataFrame:
    return search.vector_search(
        tables.text_queries(spark, directory),
        text_store(spark, directory),
        tables.posts(spark, directory),
        tables.threads(spark, directory),
        _embedder(),
    )


@query
def cosine_search(spark: SparkSession, directory: str) -> DataFrame:
    queries = tables.text_queries(spark, directory)
    hits = search.cosine_search(queries, text_store(spark, directory), _embedder())
    return hits.withColumn("similarity", F.round("similarity", 6))


@query
def format_similarity(spark: SparkSession, directory: str) -> DataFrame:
    return cosine_search(spark, directory).select("query_id", "rank", "post_id", "similarity_text")


@query
def combined_search(spark: SparkSession, directory: str) -> DataFrame:
    fused = search.combined_search(
        tables.keyword_queries(spark, directory, FUSED_LIMITS),
        text_store(spark, directory),
        tables.posts(spark, directory),
        tables.threads(spark, directory),
        _embedder(),
        _origin(),
    )
    return fused.withColumn("score", F.round("score", 6))


@query
def render_results(spark: SparkSession, directory: str) -> DataFrame:
    return results.render(_details(spark, directory))


# Maintenance jobs


@query
def backfill_batch(spark: SparkSession, directory: str) -> DataFrame:
    filled = maintenance.backfilled_store(
        tables.posts(spark, directory), tables.embedding_store(spark, directory), ops.POST, _embedder(), DIM, _now()
    )
    return _store_rows(filled)


@query
def repair_store(spark: SparkSession, directory: str) -> DataFrame:
    repaired = maintenance.repair(
        tables.damaged_store(spark, directory), tables.posts(spark, directory), ops.POST, _embedder(), DIM, _now()
    )
    checked = ops.with_validation(repaired, DIM)
    finite = F.col("reason").isin("none", "nonfinite")
    return checked.select(
        "post_id",
        "thread_id",
        "embedding_length",
        "is_truncated",
        F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        "reason",
        F.when(~finite, _total()).alias("total"),
    )


@query
def rebuild_store(spark: SparkSession, directory: str) -> DataFrame:
    rebuilt = maintenance.rebuild(
        tables.threads(spark, directory), tables.embedding_store(spark, directory), ops.THREAD, _embedder(), DIM, _now()
    )
    return _store_rows(rebuilt)


@query
def refresh_ids(spark: SparkSession, directory: str) -> DataFrame:
    damaged = ops.with_validation(tables.damaged_store(spark, directory), DIM)
    ids = damaged.where(ops.is_issue()).select("post_id")
    refreshed = maintenance.refresh(
        ids,
        tables.posts(spark, directory),
        tables.embedding_store(spark, directory),
        ops.POST,
        _embedder(),
        DIM,
        _now(),
    )
    return _store_rows(refreshed)
