"""Search jobs over a batch of queries.

Ranking runs when a search is called: its hits, at most a result limit per query, are written to the shared folder
and only then meet posts and threads. The scan behind the ranking so runs once, though its hits are read often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forumlens.functions import text
from forumlens.operators import clauses, knn, lexical, results
from forumlens.operators.embedding import Embedder, embed_queries
from forumlens.operators.keyword_index import KeywordIndex
from forumlens.operators.ranking import BatchFigures, batch_figures, within_own_limit
from forumlens.schemas import DEFAULT_COSINE_RESULTS
from forumlens.sources.snapshots import materialize


def vector_hits(queries: DataFrame, store: DataFrame, embedder: Embedder, largest: int) -> DataFrame:
    """Nearest vectors of every text query by squared L2, each query with its own result limit."""
    return within_own_limit(knn.nearest(embed_queries(queries, embedder), store, largest), queries)


def vector_search(
    queries: DataFrame,
    store: DataFrame,
    posts: DataFrame,
    threads: DataFrame,
    embedder: Embedder,
    figures: BatchFigures | None = None,
) -> DataFrame:
    """Details of the nearest posts and threads of every query."""
    figures = figures or batch_figures(queries)
    hits = materialize(vector_hits(queries, store, embedder, figures.largest))
    return results.resolve_details(hits, posts, threads, figures.few_hits)


def cosine_search(
    queries: DataFrame, store: DataFrame, embedder: Embedder, k: int = DEFAULT_COSINE_RESULTS
) -> DataFrame:
    """The most similar stored texts with their similarity to four decimals."""
    hits = knn.nearest(embed_queries(queries, embedder), store, k, knn.COSINE)
    return hits.withColumn("similarity_text", text.four_decimals(F.col("similarity")))


def keyword_hits(
    queries: DataFrame,
    posts: DataFrame,
    threads: DataFrame,
    origin: Column,
    saved: KeywordIndex | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Ranked keyword hits, written: ``query_id, rank, score, post_id, date``.

    ``asked`` holds the clauses of the queries (``query_id, clause_no, kind, text``); without it every word of a query must
    occur. A saved index stands in for reading the texts.
    """
    units = clauses.Units(clauses.must_clauses(queries) if asked is None else asked)
    index = saved or clauses.index_for(posts, threads, units)
    return materialize(clauses.ranked(index, units, queries, origin))


def keyword_search(
    queries: DataFrame,
    posts: DataFrame,
    threads: DataFrame,
    origin: Column,
    saved: KeywordIndex | None = None,
    figures: BatchFigures | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Keyword hits with their output fields, see :func:`keyword_hits`."""
    figures = figures or batch_figures(queries)
    ranked = keyword_hits(queries, posts, threads, origin, saved, asked)
    return lexical.project_hits(ranked, posts, threads, figures.few_hits)


def combined_search(
    queries: DataFrame,
    store: DataFrame,
    posts: DataFrame,
    threads: DataFrame,
    embedder: Embedder,
    origin: Column,
    saved: KeywordIndex | None = None,
    use_keyword_date: bool = False,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Vector and keyword results of every query, merged newest first; ``asked`` as in :func:`keyword_hits`."""
    figures = batch_figures(queries)
    details = vector_search(queries, store, posts, threads, embedder, figures)
    keyword = keyword_search(queries, posts, threads, origin, saved, figures, asked)
    return results.fuse(details, keyword, use_keyword_date)
