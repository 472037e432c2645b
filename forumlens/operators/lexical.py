"""Keyword documents and the output fields of keyword hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forumlens.operators.store import titles_of

# The fields of a keyword hit.
HIT_FIELDS = ("title", "message", "date", "user", "discussion_id", "node", "post_id")


def lexical_documents(posts: DataFrame, threads: DataFrame, *extra: str) -> DataFrame:
    """One keyword document per post, with the title of its thread.

    A busy thread makes a hot join key on the posts side, which Spark's adaptive skew join splits.
    """
    return posts.join(threads.select("thread_id", "title", "node"), "thread_id", "left").select(
        "post_id",
        "title",
        "message",
        F.col("post_date").alias("date"),
        F.col("user_name").alias("user"),
        F.col("thread_id").alias("discussion_id"),
        "node",
        *extra,
    )


def _bounded(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows


def project_hits(ranked: DataFrame, posts: DataFrame, threads: DataFrame, few: bool) -> DataFrame:
    """The seven output fields of every hit.

    ``ranked`` is read twice and should be a written table; ``few`` says that it fits a broadcast, so that neither
    posts nor threads are shuffled. Hits meet the posts before the threads.
    """
    hits = ranked.select("query_id", "rank", "score", "post_id")
    titles = titles_of(hits, posts, threads.select("thread_id", "title", "node"), few)
    fields = lexical_documents(posts.join(_bounded(hits, few), "post_id"), titles, "query_id", "rank", "score")
    return fields.select("query_id", "rank", "score", *HIT_FIELDS)
