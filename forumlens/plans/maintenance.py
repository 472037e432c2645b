"""Jobs that keep the embedding store complete and valid.

Every job returns the rows to write or the next version of the store; :mod:`forumlens.sources.snapshots` writes
them. Rows that fail validation carry their reason and go to quarantine instead of the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forumlens.functions import text, vectors
from forumlens.operators import store as ops
from forumlens.operators.embedding import Embedder
from forumlens.schemas import MAX_TOKENS
from forumlens.sources.snapshots import materialize

_TEXT_COLUMN = {ops.POST: "message", ops.THREAD: "title"}


def row_key(kind: str) -> Column:
    """Row keys of vectors made from text: even for posts, odd for threads."""
    return F.col(ops.KEYS[kind]) * 2 + (0 if kind == ops.POST else 1)


def embed_items(
    items: DataFrame, kind: str, embedder: Embedder, dim: int, now: Column, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """Store rows for posts or threads, with the validation reason of each vector.

    Texts over the token limit are cut before embedding; the flag tells so from the uncut text.
    """
    key, source = ops.KEYS[kind], F.col(_TEXT_COLUMN[kind])
    flagged = items.select(key, source.alias("text"), text.is_over_limit(source, max_tokens).alias("is_truncated"))
    cut = text.truncate_tokens(F.col("text"), F.col("is_truncated"), max_tokens)
    made = flagged.select(key, "is_truncated", embedder(cut).alias("embedding"))
    ids = {k: F.col(c) if k == kind else F.lit(None).cast("bigint") for k, c in ops.KEYS.items()}
    return made.select(
        row_key(kind).alias("vec_id"),
        ids[ops.POST].alias("post_id"),
        ids[ops.THREAD].alias("thread_id"),
        "embedding",
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("embedding_length"),
        "is_truncated",
        F.lit(0).alias("section"),
        now.alias("last_updated"),
        vectors.validation_reason(F.col("embedding"), dim).alias("reason"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason") == "valid").drop("reason")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason") != "valid").drop("embedding")


def backfill(items: DataFrame, store: DataFrame, kind: str, embedder: Embedder, dim: int, now: Column) -> DataFrame:
    """Store rows, with their reason, for the items that have no vector yet."""
    return embed_items(ops.pending(items, store, ops.KEYS[kind]), kind, embedder, dim, now)


def backfilled_store(
    items: DataFrame, store: DataFrame, kind: str, embedder: Embedder, dim: int, now: Column
) -> DataFrame:
    """The store with vectors for pending items added. They are new keys, so no stored row moves."""
    return store.unionByName(accepted(backfill(items, store, kind, embedder, dim, now)))


def check(store: DataFrame, dim: int, kind: str | None = None) -> DataFrame:
    """Rows and issues per validation reason: ``reason, vectors, issues``."""
    checked = ops.with_validation(ops.of_kind(store, kind), dim)
    return checked.groupBy("reason").agg(
        F.count("*").alias("vectors"), F.count_if(ops.is_issue()).alias("issues")
    )


def repair_candidates(store: DataFrame, items: DataFrame, kind: str, dim: int) -> DataFrame:
    """Invalid vectors whose source text exists: ``key, text column, reason, length_issue``.

    The ids of invalid rows are found by one scan of the store and written, so that their true size decides the
    join: while few are invalid, the texts are read without a shuffle.
    """
    key = ops.KEYS[kind]
    invalid = ops.with_validation(store.where(F.col(key).isNotNull()), dim).where(ops.is_issue())
    found = materialize(invalid.select(key, "reason", "length_issue"))
    return found.join(items.select(key, _TEXT_COLUMN[kind]), key)


def repair(
    store: DataFrame, items: DataFrame, kind: str, embedder: Embedder, dim: int, now: Column
) -> DataFrame:
    """The store with every repairable vector made anew. Other rows are kept as they are.

    The new vectors are written first: embedding runs once, and a small repair does not shuffle the store.
    """
    broken = repair_candidates(store, items, kind, dim).drop("reason", "length_issue")
    # A key may have several broken vectors; its text is embedded once and replaces all of them.
    broken = broken.dropDuplicates([ops.KEYS[kind]])
    fixed = materialize(accepted(embed_items(broken, kind, embedder, dim, now)))
    return ops.update_existing(store, fixed, ops.KEYS[kind], now, unique=True)


def repair_report(store: DataFrame, items: DataFrame, kind: str, dim: int) -> DataFrame:
    """Rows to repair per reason."""
    return repair_candidates(store, items, kind, dim).groupBy("reason").agg(F.count("*").alias("repaired"))


def rebuild(
    items: DataFrame, store: DataFrame, kind: str, embedder: Embedder, dim: int, now: Column, every_kind: bool = False
) -> DataFrame:
    """The store with one kind deleted and embedded again; ``every_kind`` deletes all rows first.

    After the deletion every item is pending, so none has to be looked for.
    """
    cleared = ops.delete_kind(store, None if every_kind else kind)
    return cleared.unionByName(accepted(rebuilt_rows(items, kind, embedder, dim, now)))


def rebuilt_rows(items: DataFrame, kind: str, embedder: Embedder, dim: int, now: Column) -> DataFrame:
    """Store rows, with their reason, for every item: what :func:`rebuild` takes, and what it leaves out, for
    :func:`quarantined`. A written table of it serves both."""
    return embed_items(items.where(F.col(ops.KEYS[kind]) > 0), kind, embedder, dim, now)


def refresh(
    ids: DataFrame, items: DataFrame, store: DataFrame, kind: str, embedder: Embedder, dim: int, now: Column
) -> DataFrame:
    """The store with the given items embedded again and upserted; unknown ids are skipped.

    The new vectors are written once, because the upsert reads them twice.
    """
    key = ops.KEYS[kind]
    rows = materialize(accepted(embed_items(ops.lookup(items, ids, key), kind, embedder, dim, now)))
    return ops.upsert(store, rows, key)


def export_rows(store: DataFrame, dim: int, after: int = 0) -> DataFrame:
    """Validated post vectors for a search index, one per post, the last row of a post winning.

    A first pass finds the posts that have more than one valid row and writes their last row key, so that the
    vectors themselves need no shuffle while such posts are few.
    """
    candidates = store.where(F.col("post_id") > after).select("vec_id", "post_id", "embedding", "embedding_length")
    good = candidates.where(vectors.validation_reason(F.col("embedding"), dim) == "valid")
    per_post = good.groupBy("post_id").agg(F.max("vec_id").alias("last_vec_id"), F.count("*").alias("rows"))
    repeated = materialize(per_post.where(F.col("rows") > 1).select("post_id", "last_vec_id"))
    last = F.coalesce(F.col("last_vec_id"), F.col("vec_id"))
    winners = good.join(repeated, "post_id", "left").where(F.col("vec_id") == last)
    return winners.select("post_id", "embedding", "embedding_length")


def export_report(store: DataFrame, dim: int, after: int = 0) -> DataFrame:
    """Rows read and rows exported, in one pass."""
    valid = vectors.validation_reason(F.col("embedding"), dim) == "valid"
    return store.where(F.col("post_id") > after).agg(
        F.count("*").alias("processed"), F.count_if(valid).alias("exported")
    )
