"""Top-k per query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from forumlens.functions import text
from forumlens.operators.joins import BROADCAST_ROWS
from forumlens.schemas import DEFAULT_RESULTS


def with_result_limit(queries: DataFrame, default: int = DEFAULT_RESULTS) -> DataFrame:
    """Queries with ``max_results`` filled in."""
    wanted = F.col("max_results") if "max_results" in queries.columns else F.lit(None).cast("int")
    return queries.withColumn("max_results", F.coalesce(wanted, F.lit(default)))


# From this bound on, Spark does not limit the rows of a window before it shuffles them.
_LIMITED_BELOW = 1000
_PARTS = 64


def top_per_query(hits: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` hits of every query with their rank.

    A small constant bound lets Spark keep only ``k`` rows per query in each partition before it shuffles, so a
    query that matches a large part of the corpus sends ``k`` rows per task, not all its matches. For a large bound
    every query is ranked in parts first, so that no task sees more than ``k`` rows of each part.
    """
    if k >= _LIMITED_BELOW:
        part = F.pmod(F.xxhash64(*[c for c in hits.columns if c != "query_id"]), F.lit(_PARTS))
        by_part = Window.partitionBy("query_id", "_part").orderBy(*order)
        hits = hits.withColumn("_part", part).withColumn("_place", F.row_number().over(by_part))
        hits = hits.where(F.col("_place") <= k).drop("_part", "_place")
    by_query = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class BatchFigures:
    """What a search must know about its query batch before it plans: three numbers, read in one pass."""

    queries: int
    words: int
    largest: int

    @property
    def few_words(self) -> bool:
        return self.words <= BROADCAST_ROWS

    @property
    def few_hits(self) -> bool:
        return self.queries * self.largest <= BROADCAST_ROWS


def batch_figures(queries: DataFrame) -> BatchFigures:
    """Number of queries, distinct words summed over queries, and the largest ``max_results``."""
    words = F.size(F.array_distinct(text.words(F.col("query")))) if "query" in queries.columns else F.lit(0)
    counted = with_result_limit(queries).agg(
        F.count("*"), F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.max("max_results"), F.lit(0))
    )
    return BatchFigures(*counted.first())


def within_own_limit(ranked: DataFrame, queries: DataFrame, few: bool = False) -> DataFrame:
    """Ranked hits up to each query's own ``max_results``; ``few`` says that the queries fit a broadcast."""
    own = with_result_limit(queries).select("query_id", "max_results")
    own = F.broadcast(own) if few else own
    return ranked.join(own, "query_id").where(F.col("rank") <= F.col("max_results")).drop("max_results")


# Steps of a score histogram per unit of score.
_STEPS = 64


def worth_ranking(hits: DataFrame, limits: DataFrame, score: str, steps: int = _STEPS, few: bool = False) -> DataFrame:
    """The hits that can be among the first ``max_results`` of their query by descending ``score``.

    Each query's scores are counted by steps, inside the tasks first; the step in which its own limit falls is the least
    that is kept. So a query moves about as many rows as it wants, whatever other queries of the batch want. Equal scores
    share a step and stay together. ``hits`` is read twice and should be a written table; ``limits`` has ``query_id,
    max_results``. Queries without a limit keep nothing. ``few`` says that the queries fit a broadcast, so that the hits stay
    where they are.
    """
    step = F.floor(F.col(score) * steps)
    counted = hits.groupBy("query_id", step.alias("step")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("query_id").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).join(limits, "query_id")
    least = counted.where(F.col("above") < F.col("max_results")).groupBy("query_id").agg(F.min("step").alias("least_step"))
    least = F.broadcast(least) if few else least
    return hits.join(least, "query_id").where(step >= F.col("least_step")).select(*hits.columns)
