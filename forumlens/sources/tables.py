"""Table readers and the forum views that map raw tables onto the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlens.functions import text
from forumlens.schemas import RAW_TABLES

# First post date of the views and the distance between two posts, in seconds.
FIRST_POST_DATE = 1704067200
POST_INTERVAL = 3600
TURNS_PER_CONVERSATION = 8
VIEW_DIM = 64


def read_parquet(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_TABLES[name]).parquet(f"{directory}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A database table as a partitioned scan over its integer key; filters and columns are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper)
        .options(numPartitions=partitions, **options)
        .load()
    )


def write_jdbc(rows: DataFrame, url: str, table: str, batch_rows: int = 2048, **options: str) -> None:
    """Append rows to a database table, one batched insert per task."""
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch_rows, **options).mode("append").save()


def posts(spark: SparkSession, directory: str) -> DataFrame:
    sequence = F.col("conv_id") * TURNS_PER_CONVERSATION + F.col("turn")
    return read_parquet(spark, directory, "conversations").select(
        (sequence + 1).alias("post_id"),
        (F.col("conv_id") + 1).alias("thread_id"),
        F.col("role").alias("user_name"),
        F.col("text").alias("message"),
        (FIRST_POST_DATE + sequence * POST_INTERVAL).cast("bigint").alias("post_date"),
    )


def threads(spark: SparkSession, directory: str) -> DataFrame:
    """One row per conversation: the opening text is the title."""
    sequence = F.col("conv_id") * TURNS_PER_CONVERSATION + F.col("turn")
    return (
        read_parquet(spark, directory, "conversations")
        .groupBy("conv_id")
        .agg(
            F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"),
            F.max(FIRST_POST_DATE + sequence * POST_INTERVAL).cast("bigint").alias("last_post_date"),
        )
        .select(
            (F.col("conv_id") + 1).alias("thread_id"),
            "title",
            "last_post_date",
            (F.col("conv_id") % 5).alias("node"),
        )
    )


def embedding_store(spark: SparkSession, directory: str) -> DataFrame:
    """Stored vectors; every fifth belongs to a thread, the others to posts."""
    is_thread = F.col("vec_id") % 5 == 4
    return read_parquet(spark, directory, "embeddings").select(
        "vec_id",
        F.when(~is_thread, F.col("vec_id") + 1).alias("post_id"),
        F.when(is_thread, F.floor(F.col("vec_id") / 5) + 1).alias("thread_id"),
        "embedding",
        F.lit(VIEW_DIM).alias("embedding_length"),
        F.lit(False).alias("is_truncated"),
        F.lit(0).alias("section"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_updated"),
    )


def damaged_store(spark: SparkSession, directory: str) -> DataFrame:
    """The same store with every class of invalid vector planted in it."""
    fault = F.col("vec_id") % 50
    head = F.slice("embedding", 1, VIEW_DIM - 1)

    def ending_in(value: str):
        return F.concat(head, F.array(F.lit(value).cast("float")))

    return embedding_store(spark, directory).withColumns(
        {
            "embedding": F.when(fault == 1, F.lit(None))
            .when(fault == 2, head)
            .when(fault == 3, ending_in("NaN"))
            .when(fault == 4, F.transform("embedding", lambda x: (x * 1000).cast("float")))
            .when(fault == 6, ending_in("-Infinity"))
            .otherwise(F.col("embedding")),
            "embedding_length": F.when(fault == 5, VIEW_DIM - 1).otherwise(VIEW_DIM),
        }
    )


def vector_queries(spark: SparkSession, directory: str) -> DataFrame:
    """Every stored vector as a query."""
    return read_parquet(spark, directory, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def text_queries(spark: SparkSession, directory: str) -> DataFrame:
    """Whole benchmark passages as search requests without a result limit of their own."""
    return read_parquet(spark, directory, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.lit(None).cast("int").alias("max_results"),
    )


# Result limits that keyword requests have in turn, and how query ids hold item and place.
LIMITS = (None, 1, 3, 2000)
PLACES = 100_000


def _places(spark: SparkSession, directory: str, first: int) -> DataFrame:
    """``item_id, words, place``: every place of every benchmark passage, from ``first`` to its last word, which is place
    ``size(words)``."""
    passages = read_parquet(spark, directory, "benchmark").select("item_id", text.words(F.col("text")).alias("words"))
    places = F.when(F.size("words") >= first, F.sequence(F.lit(first), F.size("words")))
    return passages.select("item_id", "words", F.explode(places).alias("place"))


def _in_turn(values: tuple, number):
    return F.element_at(F.array(*[F.lit(value).cast("int") for value in values]), (number % len(values) + 1).cast("int"))


def _word(offset: int):
    """The word so many places after the place of a row; NULL beyond the passage."""
    return F.get("words", F.col("place") - 1 + offset)


def keyword_queries(spark: SparkSession, directory: str, limits: tuple = LIMITS) -> DataFrame:
    """Each pair of neighbouring words of every benchmark passage, its last word alone, and a blank request."""
    query = F.when(F.col("place") == 0, F.lit(" ")).otherwise(F.concat_ws(" ", _word(0), _word(1)))
    return _places(spark, directory, 0).select(
        (F.col("item_id") * PLACES + F.col("place")).alias("query_id"),
        query.alias("query"),
        _in_turn(limits, F.col("place")).alias("max_results"),
    )


def word_clauses(spark: SparkSession, directory: str, kinds: tuple[str, str]) -> DataFrame:
    """A clause for each word of every keyword request, of the given kinds in turn."""
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("clause_no") + 1)
    listed = keyword_queries(spark, directory).select("query_id", F.posexplode(text.words(F.col("query"))).alias("clause_no", "text"))
    return listed.select("query_id", "clause_no", kind.alias("kind"), "text")


def passage_clauses(spark: SparkSession, directory: str) -> DataFrame:
    """Every different word of a benchmark passage as a clause of one request, of which one is enough."""
    listed = text_queries(spark, directory).select(
        "query_id", F.posexplode(F.array_distinct(text.words(F.col("query")))).alias("clause_no", "text")
    )
    return listed.select("query_id", "clause_no", F.lit("should").alias("kind"), "text")


def phrase_clauses(spark: SparkSession, directory: str) -> DataFrame:
    """Every run of 2 to 6 neighbouring words of every benchmark passage as a phrase."""
    sized = _places(spark, directory, 1).select("*", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("size"))
    whole = sized.where(F.col("place") + F.col("size") - 1 <= F.size("words"))
    return whole.select(
        (F.col("item_id") * PLACES + F.col("place") * 10 + F.col("size")).alias("query_id"),
        F.lit(0).alias("clause_no"),
        F.lit("phrase").alias("kind"),
        F.array_join(F.slice("words", F.col("place"), F.col("size")), " ").alias("text"),
    )


def prefix_clauses(spark: SparkSession, directory: str) -> DataFrame:
    """Every keyword request with its last word as the start of a word."""
    listed = keyword_queries(spark, directory).select("query_id", text.words(F.col("query")).alias("words"))
    listed = listed.select("query_id", F.size("words").alias("size"), F.posexplode("words").alias("clause_no", "text"))
    kind = F.when(F.col("clause_no") == F.col("size") - 1, "prefix").otherwise("must")
    return listed.select("query_id", "clause_no", kind.alias("kind"), "text")


def mixed_clauses(spark: SparkSession, directory: str) -> DataFrame:
    """A request of several clauses at every place of every benchmark passage, of four shapes in turn: a required, an
    optional and a forbidden word; a phrase of 2 to 6 words and an optional word; a required word and the start of one; two
    optional words and a forbidden one."""
    place = F.col("place")
    size = (F.floor(place / 4) % 5 + 2).cast("int")
    phrase = F.array_join(F.slice("words", place, size), " ")

    def clauses(*listed):
        return F.array(*[F.struct(F.lit(kind).alias("kind"), part.alias("text")) for kind, part in listed])

    after = F.get("words", place - 1 + size)
    shapes = (
        F.when(place % 4 == 0, clauses(("must", _word(0)), ("should", _word(1)), ("must_not", _word(2))))
        .when(place % 4 == 1, clauses(("phrase", phrase), ("should", after)))
        .when(place % 4 == 2, clauses(("must", _word(0)), ("prefix", _word(1))))
        .otherwise(clauses(("should", _word(0)), ("should", _word(1)), ("must_not", _word(2))))
    )
    listed = _places(spark, directory, 1).select(
        (F.col("item_id") * PLACES + place).alias("query_id"), F.posexplode(shapes).alias("clause_no", "clause")
    )
    return listed.where(F.col("clause.text").isNotNull()).select("query_id", "clause_no", "clause.kind", "clause.text")


def mixed_queries(spark: SparkSession, directory: str) -> DataFrame:
    """``query_id, max_results`` of the requests of :func:`mixed_clauses`."""
    return _places(spark, directory, 1).select(
        (F.col("item_id") * PLACES + F.col("place")).alias("query_id"),
        _in_turn(LIMITS, F.floor(F.col("place") / 4)).alias("max_results"),
    )
