"""Text to vector. An embedder is a function from a text column to an ``array<float>`` column.

Embedders are marked nondeterministic, so that a filter on the vector stays above the call and does not repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from forumlens.functions import text
from forumlens.schemas import EMBED_BATCH_ROWS

Embedder = Callable[[Column], Column]

_VECTOR = T.ArrayType(T.FloatType())
_CELLS = 1 << 22


def _bucket_and_sign(word: str, dim: int) -> tuple[int, int]:
    digest = hashlib.md5(word.encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % dim, 1 if int(digest[8], 16) % 2 == 0 else -1


def _hashed_vectors(lists: pa.ListArray, dim: int) -> pa.ListArray:
    """Signed word counts per bucket (feature hashing), scaled to unit length; NULL where nothing is left."""
    rows = len(lists)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    encoded = lists.flatten().dictionary_encode()
    places = [_bucket_and_sign(word, dim) for word in encoded.dictionary.to_pylist()]
    bucket, sign = np.array(places, dtype=np.int64).reshape(-1, 2).T
    word = encoded.indices.to_numpy()
    cell = np.repeat(np.arange(rows) * dim, sizes) + bucket[word]
    counts = np.bincount(cell, weights=sign[word], minlength=rows * dim).reshape(rows, dim)
    norms = np.sqrt((counts * counts).sum(axis=1))
    vectors = (counts / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()), mask=pa.array(norms == 0))


def hashed_embedder(dim: int) -> Embedder:
    """A model-free embedder: words are found by Spark, counted per bucket in one Arrow pass, never shuffled."""

    @F.arrow_udf(_VECTOR)
    def vectors(lists: pa.Array) -> pa.Array:
        step = max(1, _CELLS // dim)
        parts = [_hashed_vectors(lists[start : start + step], dim) for start in range(0, len(lists), step)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    once = vectors.asNondeterministic()
    return lambda column: once(text.words(column))


def model_embedder(
    load: Callable[[], Callable[[list[str]], np.ndarray]], batch_rows: int = EMBED_BATCH_ROWS
) -> Embedder:
    """An embedder around a user model.

    ``load`` runs once per task and returns a function from a list of texts to a matrix of vectors; it is
    called with at most ``batch_rows`` texts. The number of partitions sets how many calls run at a time, and
    Spark retries a failed task.
    """

    @F.arrow_udf(_VECTOR)
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = load()
        for batch in batches:
            out: list = [None] * len(batch)
            known = np.flatnonzero(batch.is_valid().to_numpy(zero_copy_only=False))
            for start in range(0, len(known), batch_rows):
                rows = known[start : start + batch_rows]
                result = np.asarray(embed(batch.take(pa.array(rows)).to_pylist()), dtype=np.float32)
                for row, vector in zip(rows, result):
                    out[row] = vector
            yield pa.array(out, pa.list_(pa.float32()))

    return vectors.asNondeterministic()


def embed_column(items: DataFrame, column: str, embedder: Embedder) -> DataFrame:
    return items.withColumn("embedding", embedder(F.col(column)))


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """Query vectors; blank queries run no search."""
    return embed_column(queries.where(~text.is_blank(F.col("query"))), "query", embedder)
