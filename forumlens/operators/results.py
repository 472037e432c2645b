"""From hits to results: details, fusion, JSON and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from forumlens.functions import text
from forumlens.operators.store import POST, THREAD, titles_of, with_kind
from forumlens.schemas import (
    COMBINED_RESULTS_KEY,
    DETAIL,
    KEYWORD_RESULTS_KEY,
    VECTOR_RESPONSE,
    VECTOR_RESULTS_KEY,
)

VECTOR_SOURCE = 0
KEYWORD_SOURCE = 1


def post_details(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """Posts with the title of their thread; posts without a thread are dropped."""
    titles = threads.select("thread_id", F.col("title").alias("thread_title"))
    return posts.select("post_id", "thread_id", "message", "post_date").join(titles, "thread_id")


def resolve_details(hits: DataFrame, posts: DataFrame, threads: DataFrame, few: bool) -> DataFrame:
    """Details of ranked hits: ``query_id, rank`` and the fields of a result.

    ``hits`` is read several times and should be a written table; ``few`` says that it fits a broadcast, so that
    neither posts nor threads are shuffled. Hits whose post or thread is gone are dropped and leave a gap in the
    ranks.
    """

    def sized(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    tagged = with_kind(hits)
    post_hits = tagged.where(F.col("type") == POST).select("query_id", "rank", "type", "post_id")
    thread_hits = tagged.where(F.col("type") == THREAD).select("query_id", "rank", "type", "thread_id")
    found = posts.select("post_id", "thread_id", "message", "post_date").join(sized(post_hits), "post_id")
    titles = titles_of(post_hits, posts, threads.select("thread_id", F.col("title").alias("thread_title")), few)
    titled = threads.select("thread_id", "title", "last_post_date").join(sized(thread_hits), "thread_id")
    columns = ["query_id", "rank", *DETAIL.names]
    details = found.join(titles, "thread_id").unionByName(titled, allowMissingColumns=True)
    return details.select(*columns)


def fuse(vector_details: DataFrame, keyword_hits: DataFrame, use_keyword_date: bool = False) -> DataFrame:
    """Both result lists in one order, newest first, duplicates kept.

    A result sorts by its post date, or else its last post date, or else 0. Keyword hits carry neither, so they
    follow in score order; ``use_keyword_date`` lets their own date count. Equal dates keep the order of the
    sources, vector hits first, and of the ranks within a source.
    """
    first = vector_details.withColumn("source_no", F.lit(VECTOR_SOURCE))
    second = keyword_hits.withColumn("source_no", F.lit(KEYWORD_SOURCE))
    both = first.unionByName(second, allowMissingColumns=True)
    dates = ["post_date", "last_post_date"] + (["date"] if use_keyword_date else [])
    keyed = both.withColumn("sort_key", F.coalesce(*dates, F.lit(0).cast("bigint")))
    by_query = Window.partitionBy("query_id").orderBy(F.col("sort_key").desc(), "source_no", "rank")
    return keyed.withColumn("position", F.row_number().over(by_query))


def _as_list(order: str, fields: Column) -> Column:
    """The results of a group in order. A group holds at most two result limits of rows."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), fields.alias("item"))))
    return F.transform(ordered, lambda s: s["item"])


def _fields(names: list[str]) -> Column:
    return F.struct(*names)


def _responses(grouped: DataFrame, queries: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """One JSON document per query; a query without results has empty lists."""
    if queries is not None:
        grouped = queries.select("query_id").join(grouped, "query_id", "left")
        kinds = {key: grouped.schema[key].dataType for key in keys}
        grouped = grouped.select("query_id", *[F.coalesce(key, F.array().cast(kind)).alias(key) for key, kind in kinds.items()])
    return grouped.select("query_id", F.to_json(F.struct(*keys)).alias("response"))


def vector_json(details: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One JSON response per query of ``queries``, or else per query with results. Fields a result lacks are left out."""
    grouped = details.groupBy("query_id").agg(_as_list("rank", _fields(DETAIL.names)).alias(VECTOR_RESULTS_KEY))
    return _responses(grouped, queries, (VECTOR_RESULTS_KEY,))


def keyword_json(hits: DataFrame, keyword_fields: tuple[str, ...], queries: DataFrame | None = None) -> DataFrame:
    """The same for keyword hits with the fields of :func:`forumlens.operators.lexical.project_hits`."""
    grouped = hits.groupBy("query_id").agg(_as_list("rank", _fields(list(keyword_fields))).alias(KEYWORD_RESULTS_KEY))
    return _responses(grouped, queries, (KEYWORD_RESULTS_KEY,))


def combined_json(fused: DataFrame, keyword_fields: tuple[str, ...], queries: DataFrame | None = None) -> DataFrame:
    """One JSON response per query with the two lists and their fusion, or with the fusion of nothing."""
    names = DETAIL.names + [f for f in keyword_fields if f not in DETAIL.names]
    item = _fields(names)
    from_vector, from_keyword = (
        F.when(F.col("source_no") == source, F.struct(F.col("rank").alias("at"), item.alias("item")))
        for source in (VECTOR_SOURCE, KEYWORD_SOURCE)
    )

    def listed(rows: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["item"])

    grouped = fused.groupBy("query_id").agg(
        listed(from_vector).alias(VECTOR_RESULTS_KEY),
        listed(from_keyword).alias(KEYWORD_RESULTS_KEY),
        _as_list("position", item).alias(COMBINED_RESULTS_KEY),
    )
    return _responses(grouped, queries, (VECTOR_RESULTS_KEY, KEYWORD_RESULTS_KEY, COMBINED_RESULTS_KEY))


def write_json(responses: DataFrame, directory: str) -> None:
    """One response document per line."""
    responses.select("response").write.mode("errorifexists").text(directory)


def results_from_json(responses: DataFrame) -> DataFrame:
    """Results of JSON responses, one row each: ``query_id, position`` and the fields of a result."""
    parsed = F.from_json("response", VECTOR_RESPONSE)
    listed = responses.select("query_id", F.posexplode(parsed[VECTOR_RESULTS_KEY]).alias("position", "result"))
    return listed.select("query_id", "position", "result.*")


def render(details: DataFrame) -> DataFrame:
    """Display fields of every result: escaped heading and body, readable date."""
    return details.select(
        "query_id",
        "rank",
        text.html_escape(F.coalesce("thread_title", "title")).alias("heading"),
        text.html_escape(F.coalesce("message", F.lit(""))).alias("body"),
        text.epoch_text(F.coalesce("post_date", "last_post_date")).alias("posted_at"),
    )


def queries_without_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """A message for every query that found nothing."""
    empty = queries.where(~text.is_blank(F.col("query"))).join(hits.select("query_id"), "query_id", "left_anti")
    quoted = F.concat(F.lit('No results found for "'), text.html_escape(F.col("query")), F.lit('".'))
    return empty.select("query_id", quoted.alias("message"))
