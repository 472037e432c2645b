"""Positional keyword index over posts and their thread titles, in segments.

A posting says where one word stands in one field of one post. Postings lie by word in bucket folders; a block sums up the
postings of one word and field in one span of post ids, and the sorted word table says how many posts have a word. A segment
is written once and never changes: added posts are a new segment, deleted posts are a segment of their ids with negative
figures, and the figures of the index are the sums over its segments. A version names the segments that count.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlens.functions import text
from forumlens.sources.snapshots import materialize
from forumlens.sources.versions import publish, published

TITLE, MESSAGE = 0, 1
# Post ids of a span, and bucket folders of a saved index.
SPAN, WORD_BUCKETS = 4096, 1024

_VERSION = "segments array<int>, deletions array<int>, buckets int, span bigint"
_POSTINGS = "term string, field int, post_id bigint, date bigint, length int, positions array<int>, span bigint"
_BLOCKS = (
    "term string, field int, span bigint, posts bigint, most int, least int, first_date bigint, last_date bigint, undated boolean"
)
_TERMS = "term string, title_posts bigint, message_posts bigint"
_LENGTHS = "post_id bigint, title_length int, message_length int"
_CORPUS = "posts bigint, title_words bigint, message_words bigint"


@dataclass(frozen=True)
class KeywordIndex:
    """Postings, blocks, words and corpus figures. ``deleted`` has ``post_id, last_deleted``: rows of earlier segments do
    not count; None where nothing was deleted. ``buckets`` is None for an index that is not saved."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame
    span: int = SPAN
    buckets: int | None = None
    deleted: DataFrame | None = None
    lengths: DataFrame | None = None

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (``post_id, segment``) of posts that were not deleted after their segment."""
        if self.deleted is None:
            return rows
        gone = (rows["post_id"] == self.deleted["post_id"]) & (rows["segment"] < self.deleted["last_deleted"])
        return rows.join(self.deleted, gone, "left_anti")

    def keyed(self, words: DataFrame) -> DataFrame:
        """Rows with ``term``, with the bucket of the term where the index has buckets."""
        return words if self.buckets is None else words.withColumn("bucket", bucket_of(self.buckets))

    @property
    def key(self) -> list[str]:
        return ["term"] if self.buckets is None else ["bucket", "term"]


def bucket_of(count: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(count)).cast("int")


def _placed_words(lists: pa.Array) -> pa.Array:
    """Different words of every list with the places where they stand, counted from 0."""
    rows = len(lists)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(rows), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((place, codes, row))
    code, own = codes[order], row[order]
    first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(own) != 0))) if len(code) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(code)), pa.int32())
    positions = pa.ListArray.from_arrays(offsets, pa.array(place[order], pa.int32()))
    terms = encoded.dictionary.take(pa.array(code[first])).cast(pa.string())
    outer = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own[first], minlength=rows))]), pa.int32())
    return pa.ListArray.from_arrays(outer, pa.StructArray.from_arrays([terms, positions], ["term", "positions"]))


def _words_of(rows: DataFrame, column: str, *carry: str) -> DataFrame:
    """``carry, length, term, positions`` of every word of a text column; no row moves."""
    # Marked nondeterministic, so that no filter inferred from the generator repeats the call.
    placed = F.arrow_udf(_placed_words, "array<struct<term:string,positions:array<int>>>").asNondeterministic()
    found = rows.select(*carry, text.words(F.col(column)).alias("words"))
    found = found.select(*carry, F.size("words").alias("length"), placed("words").alias("placed"))
    return found.select(*carry, "length", F.inline("placed"))


def field_postings(posts: DataFrame, threads: DataFrame, span: int = SPAN, asked: DataFrame | None = None) -> DataFrame:
    """Postings of messages and titles; of the ``asked`` words (``term``) alone if they are given.

    Words are found where the texts lie: messages do not move at all, and of a thread only the words of its title meet the
    ids and dates of its posts. A busy thread makes a hot join key, which Spark's adaptive skew join splits.
    """
    messages = _words_of(posts.withColumn("date", F.col("post_date")), "message", "post_id", "date")
    titles = _words_of(threads, "title", "thread_id")
    if asked is not None:
        messages, titles = messages.join(asked, "term", "left_semi"), titles.join(asked, "term", "left_semi")
    titles = titles.join(posts.select("post_id", "thread_id", F.col("post_date").alias("date")), "thread_id").drop("thread_id")
    both = messages.withColumn("field", F.lit(MESSAGE)).unionByName(titles.withColumn("field", F.lit(TITLE)))
    return both.select(
        "term", "field", "post_id", "date", "length", "positions", F.floor(F.col("post_id") / span).alias("span")
    )


def field_lengths(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """``post_id, title_length, message_length``: words of either field. Only counts and ids move."""
    own = posts.select("post_id", "thread_id", F.size(text.words(F.col("message"))).alias("message_length"))
    titles = threads.select("thread_id", F.size(text.words(F.col("title"))).alias("title_length"))
    joined = own.join(titles, "thread_id", "left")
    return joined.select("post_id", F.coalesce("title_length", F.lit(0)).alias("title_length"), "message_length")


def corpus_figures(lengths: DataFrame, sign: int = 1) -> DataFrame:
    """Posts and words of either field, in one row."""
    return lengths.agg(
        (F.count("*") * sign).alias("posts"),
        (F.coalesce(F.sum("title_length"), F.lit(0)) * sign).alias("title_words"),
        (F.coalesce(F.sum("message_length"), F.lit(0)) * sign).alias("message_words"),
    )


def block_figures(postings: DataFrame, *key: str) -> DataFrame:
    """What bounds the scores of a word's postings in one field and span: the most occurrences and the fewest words of the
    field, and the dates."""
    return postings.groupBy(*key, "term", "field", "span").agg(
        F.count("*").alias("posts"),
        F.max(F.size("positions")).alias("most"),
        F.min("length").alias("least"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max(F.col("date").isNull()).alias("undated"),
    )


def term_figures(blocks: DataFrame, sign: int = 1) -> DataFrame:
    """Posts per word and field."""
    counted = [F.sum(F.when(F.col("field") == field, F.col("posts")).otherwise(0)) * sign for field in (TITLE, MESSAGE)]
    return blocks.groupBy("term").agg(counted[0].alias("title_posts"), counted[1].alias("message_posts"))


def build(posts: DataFrame, threads: DataFrame, asked: DataFrame | None = None, span: int = SPAN) -> KeywordIndex:
    """An index for one batch of searches, of the ``asked`` words alone if they are given. Its postings are written once,
    since figures and matches both read them."""
    rows = materialize(field_postings(posts, threads, span, asked).withColumn("segment", F.lit(0)))
    blocks = materialize(block_figures(rows))
    return KeywordIndex(rows, blocks, term_figures(blocks), corpus_figures(field_lengths(posts, threads)), span)


def _folder(directory: str, part: str, segment: int) -> str:
    return f"{directory}/{part}/segment={segment}"


def _read_parts(spark: SparkSession, directory: str, part: str, segments: list[int], schema: str) -> DataFrame:
    paths = [_folder(directory, part, segment) for segment in segments]
    rows = spark.read.schema(f"{schema}, segment int").option("basePath", f"{directory}/{part}")
    return rows.parquet(*paths) if paths else spark.createDataFrame([], f"{schema}, segment int")


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", F.col("bucket"))


def _write_postings(postings: DataFrame, directory: str, segment: int, buckets: int) -> None:
    """Postings and what is derived from them. Both are dealt by bucket, so a file holds few buckets, and Spark splits a large
    bucket by the tasks it comes from, so a frequent word fills many files. Ranges would need a sample, for which every text
    would be cut into words once more."""
    spark = postings.sparkSession
    order = ["bucket", "term", "field", "post_id"]
    ordered = _by_bucket(postings.withColumn("bucket", bucket_of(buckets))).sortWithinPartitions(*order)
    target = _folder(directory, "postings", segment)
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(target)
    saved = spark.read.schema(f"{_POSTINGS}, bucket int").parquet(target)
    blocks = _by_bucket(block_figures(saved, "bucket"))
    target = _folder(directory, "blocks", segment)
    blocks.sortWithinPartitions("bucket", "term", "span").write.mode("overwrite").partitionBy("bucket").parquet(target)
    saved_blocks = spark.read.schema(f"{_BLOCKS}, bucket int").parquet(target)
    terms = term_figures(saved_blocks).repartitionByRange("term").sortWithinPartitions("term")
    terms.write.mode("overwrite").parquet(_folder(directory, "terms", segment))


def _write_lengths(lengths: DataFrame, directory: str, segment: int) -> None:
    target = _folder(directory, "lengths", segment)
    lengths.write.mode("overwrite").parquet(target)
    saved = lengths.sparkSession.read.schema(_LENGTHS).parquet(target)
    corpus_figures(saved).write.mode("overwrite").parquet(_folder(directory, "corpus", segment))


def _next(found: dict | None) -> int:
    return found["version"] + 1 if found else 0


def add(
    posts: DataFrame, threads: DataFrame, directory: str, buckets: int = WORD_BUCKETS, span: int = SPAN
) -> KeywordIndex:
    """Add posts as a new segment and publish it; the first call makes the index, whose buckets and span then stay.

    Posts that the index has already are replaced: what it had of them is deleted in the same version. ``threads`` must
    hold the threads of these posts.
    """
    spark = posts.sparkSession
    found = published(spark, directory, _VERSION)
    if found:
        present = read(spark, directory).lengths.select("post_id").join(posts.select("post_id"), "post_id", "left_semi")
        present = materialize(present)
        if not present.isEmpty():
            _publish_deletion(spark, directory, present, found)
            found = published(spark, directory, _VERSION)
        buckets, span = found["buckets"], found["span"]
    segment = _next(found)
    _write_postings(field_postings(posts, threads, span), directory, segment, buckets)
    _write_lengths(field_lengths(posts, threads), directory, segment)
    segments, deletions = (found["segments"], found["deletions"]) if found else ([], [])
    publish(spark, directory, segment, _VERSION, [*segments, segment], deletions, buckets, span)
    return read(spark, directory)


def delete(spark: SparkSession, directory: str, ids: DataFrame) -> KeywordIndex:
    """Delete posts by id (``post_id``) and publish; ids that the index does not have are skipped."""
    _publish_deletion(spark, directory, ids, published(spark, directory, _VERSION))
    return read(spark, directory)


def _publish_deletion(spark: SparkSession, directory: str, ids: DataFrame, found: dict) -> None:
    """A segment of deleted ids: its figures are those of the deleted posts, with a minus. Only ids and counts move."""
    index, segment = read(spark, directory), _next(found)
    lengths = index.lengths.join(ids.select("post_id").distinct(), "post_id", "left_semi")
    target = _folder(directory, "deleted", segment)
    lengths.select(*[name.split()[0] for name in _LENGTHS.split(", ")]).write.mode("overwrite").parquet(target)
    gone = spark.read.schema(_LENGTHS).parquet(target)
    words = index.live(index.postings.select("term", "field", "post_id", "segment")).join(gone.select("post_id"), "post_id", "left_semi")
    counted = words.groupBy("term", "field").agg(F.count("*").alias("posts"))
    term_figures(counted, -1).write.mode("overwrite").parquet(_folder(directory, "terms", segment))
    corpus_figures(gone, -1).write.mode("overwrite").parquet(_folder(directory, "corpus", segment))
    deletions = [*found["deletions"], segment]
    publish(spark, directory, segment, _VERSION, found["segments"], deletions, found["buckets"], found["span"])


def compact(spark: SparkSession, directory: str) -> KeywordIndex:
    """Rewrite all that counts as one segment and publish it. Earlier versions stay readable until their owner removes them."""
    found, index = published(spark, directory, _VERSION), read(spark, directory)
    segment = _next(found)
    _write_postings(index.live(index.postings).drop("segment", "bucket"), directory, segment, found["buckets"])
    _write_lengths(index.lengths.drop("segment"), directory, segment)
    publish(spark, directory, segment, _VERSION, [segment], [], found["buckets"], found["span"])
    return read(spark, directory)


def read(spark: SparkSession, directory: str) -> KeywordIndex:
    """The last published version."""
    found = published(spark, directory, _VERSION)
    if not found:
        raise ValueError(f"no index was published in {directory}")
    segments, deletions = found["segments"], found["deletions"]

    def parts(name: str, schema: str, of: list[int]) -> DataFrame:
        return _read_parts(spark, directory, name, of, schema)

    every = [*segments, *deletions]
    terms = parts("terms", _TERMS, every)
    if len(every) > 1:
        summed = terms.groupBy("term").agg(F.sum("title_posts").alias("title_posts"), F.sum("message_posts").alias("message_posts"))
        terms = summed.where(F.col("title_posts") + F.col("message_posts") > 0)
    corpus = parts("corpus", _CORPUS, every).agg(*[F.sum(name).alias(name) for name in ("posts", "title_words", "message_words")])
    gone = parts("deleted", "post_id bigint", deletions).groupBy("post_id").agg(F.max("segment").alias("last_deleted"))
    index = KeywordIndex(
        parts("postings", f"{_POSTINGS}, bucket int", segments), parts("blocks", f"{_BLOCKS}, bucket int", segments),
        terms.drop("segment"), corpus, found["span"], found["buckets"], gone if deletions else None,
    )
    lengths = index.live(parts("lengths", _LENGTHS, segments))
    return replace(index, lengths=lengths)
