"""Exact nearest neighbours of a batch of query vectors.

The store is read once, where it lies. A task holds a chunk of its vectors, grouped by their nearest pivot, and reads the
query batch from the shared folder slice by slice; no query passes through the driver. Pivots are stored vectors, so the
k-th nearest of them bounds how far a neighbour of a query can be, and by the triangle inequality a group whose pivot is
farther than that bound and the group's radius together holds none: it is skipped. Where that leaves out little, all vectors
are compared in whole blocks. The best k are kept per query, so a task sends at most k rows per query and chunk to the final ranking and vectors never shuffle. Vectors are
compared with queries of their own length, whatever other lengths the batch holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from forumlens.operators.ranking import top_per_query
from forumlens.sources.snapshots import materialize, read_slices, write_slices

L2 = "l2"
COSINE = "cosine"

# Scores are compared at this many decimals, so that equal scores stay ties whatever order their sums ran in.
RANK_DECIMALS = 9

# A slice of the query batch has so many vectors and numbers (32 MB of doubles) at most, and a chunk of stored vectors so
# many numbers (128 MB of doubles).
SLICE_QUERIES, SLICE_VALUES, CHUNK_VALUES = 4096, 1 << 22, 1 << 24
# Stored vectors that reach the driver and every task as pivots, and their numbers at most.
PIVOTS, PIVOT_VALUES = 512, 1 << 20
_BLOCK_SCORES = 1 << 22
# Where more than this share of the pairs of a query and a group is in reach, all vectors are compared in whole blocks.
_DENSE_SHARE = 0.25
_EXACT_VALUES = 1 << 23


@dataclass(frozen=True)
class QueryBlock:
    """Query vectors as one matrix."""

    ids: np.ndarray
    matrix: np.ndarray

    @staticmethod
    def by_length(rows: pa.Table, metric: str) -> list[QueryBlock]:
        """One block per vector length; queries without a score are left out."""
        ids = rows.column("query_id").combine_chunks().to_numpy(zero_copy_only=False)
        vectors = rows.column("embedding").combine_chunks()
        lengths = np.unique(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy())
        found = ((ids, *_matrix(vectors, int(length), metric)) for length in lengths if length)
        return [QueryBlock(ids[known], matrix) for ids, known, matrix in found if len(known)]


def _matrix(vectors: pa.ListArray, dim: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and doubles of the vectors that have a score: right length, finite, nonzero for cosine."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    rows = np.flatnonzero(sizes == dim)
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.float64).reshape(len(rows), dim)
    usable = np.isfinite(matrix).all(axis=1)
    if metric == COSINE:
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        usable &= norms > 0
        matrix = matrix / np.where(norms > 0, norms, 1.0)[:, None]
    return rows[usable], matrix[usable]


class _BestHits:
    """The best k hits of every query of a block seen so far; ``worst`` are scores that better ones must not exceed."""

    def __init__(self, block: QueryBlock, k: int, metric: str, columns: list[str], worst: np.ndarray | None = None):
        self.block, self.k, self.metric, self.columns = block, k, metric, columns
        self.squares = (block.matrix * block.matrix).sum(axis=1)
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.rows: pa.Table | None = None
        self.worst = np.full(len(block.ids), np.inf) if worst is None else worst.copy()
        self.full = np.zeros(len(block.ids), bool)

    def add(self, vectors: np.ndarray, payload: pa.Table, asked: np.ndarray) -> None:
        """Compare vectors with the queries whose places are ``asked``."""
        step = max(1, _BLOCK_SCORES // max(1, len(asked)))
        for start in range(0, len(vectors), step):
            self._add_block(vectors[start : start + step], payload.slice(start, step), asked)

    def _add_block(self, vectors: np.ndarray, payload: pa.Table, asked: np.ndarray) -> None:
        every = len(asked) == len(self.block.ids)
        queries, squares = (self.block.matrix, self.squares) if every else (self.block.matrix[asked], self.squares[asked])
        # Rough scores from one matrix product, then exact scores for the few pairs that can still win.
        if self.metric == L2:
            own, ones = (vectors * vectors).sum(axis=1), np.ones
            left = np.column_stack([vectors, own, ones(len(vectors))])
            rough = left @ np.column_stack([-2.0 * queries, ones(len(queries)), squares]).T
            size = float(own.max(initial=0.0)) + float(squares.max(initial=0.0))
            margin = _rounding(queries.shape[1] + 2, size) + 10.0**-RANK_DECIMALS
        else:
            rough = vectors @ -queries.T
            margin = _rounding(queries.shape[1], 1.0) + 10.0**-RANK_DECIMALS
        bound = self.worst[asked]
        # The k-th score of a block bounds a query only as long as it has not k hits of its own.
        if len(vectors) > self.k and not self.full[asked].all():
            bound = np.minimum(bound, np.partition(rough, self.k - 1, axis=0)[self.k - 1] + margin)
        row, place = np.nonzero(rough <= bound + margin)
        if not len(row):
            return
        query = asked[place]
        self._merge(query, self._exact(vectors, row, query), payload.take(pa.array(row)))

    def _exact(self, vectors: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        scores = np.empty(len(row))
        step = max(1, _EXACT_VALUES // vectors.shape[1])
        for start in range(0, len(row), step):
            part = slice(start, start + step)
            a, b = vectors[row[part]], self.block.matrix[query[part]]
            scores[part] = ((a - b) ** 2).sum(axis=1) if self.metric == L2 else -(a * b).sum(axis=1)
        return scores

    def _merge(self, query: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
        if self.rows is not None:
            query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
            rows = pa.concat_tables([self.rows, rows])
        ids = rows.column("vec_id").to_numpy()
        rounded = np.round(score, RANK_DECIMALS)
        order = np.lexsort((ids, rounded, query))
        ordered = query[order]
        first = np.searchsorted(ordered, ordered, side="left")
        place = np.arange(len(order)) - first
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.query, self.score, self.rows = query[keep], score[keep], rows.take(pa.array(keep))
        self.worst[query[last]] = np.minimum(self.worst[query[last]], rounded[last])
        self.full[query[last]] = True

    def result(self) -> dict[str, pa.Array]:
        if self.rows is None:
            return {}
        columns = {"query_id": pa.array(self.block.ids[self.query]), "score": pa.array(self.score)}
        return columns | {name: self.rows.column(name) for name in self.columns}


def _rounding(dim: int, size: float) -> float:
    """How far a sum of products may be off."""
    return 4.0 * dim * np.finfo(np.float64).eps * size


@dataclass(frozen=True)
class Pivots:
    """Pivots of one vector length, as rows of a matrix (of unit length for cosine)."""

    matrix: np.ndarray

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, float]:
        """Distances to all pivots, and how far they may be off."""
        squares, own = (vectors * vectors).sum(axis=1), (self.matrix * self.matrix).sum(axis=1)
        size = squares[:, None] + own[None, :]
        off = _rounding(vectors.shape[1], float(size.max(initial=0.0)))
        return np.sqrt(np.maximum(size - 2.0 * (vectors @ self.matrix.T), 0.0)), math.sqrt(off)


@dataclass
class _Chunk:
    """Stored vectors of one length, in groups of a common nearest pivot."""

    vectors: np.ndarray
    payload: pa.Table
    pivots: Pivots | None
    groups: np.ndarray
    starts: np.ndarray
    radii: np.ndarray
    off: float

    @staticmethod
    def of(vectors: np.ndarray, payload: pa.Table, pivots: Pivots | None) -> _Chunk:
        if pivots is None:
            return _Chunk(vectors, payload, None, np.zeros(1, np.int64), np.array([0, len(vectors)]), np.zeros(1), 0.0)
        nearest, distance, off = np.empty(len(vectors), np.int64), np.empty(len(vectors)), 0.0
        step = max(1, _BLOCK_SCORES // len(pivots.matrix))
        for start in range(0, len(vectors), step):
            part = slice(start, start + step)
            found, part_off = pivots.distances(vectors[part])
            nearest[part] = found.argmin(axis=1)
            distance[part] = found.min(axis=1)
            off = max(off, part_off)
        order = np.argsort(nearest, kind="stable")
        groups, starts = np.unique(nearest[order], return_index=True)
        radii = np.maximum.reduceat(distance[order], starts) if len(starts) else np.empty(0)
        return _Chunk(vectors[order], payload.take(pa.array(order)), pivots, groups, np.append(starts, len(order)), radii, off)

    def search(self, block: QueryBlock, k: int, metric: str, columns: list[str]) -> tuple[_BestHits, int, int]:
        """The best hits of the block here, the pairs of a query and a group, and how many of them were compared."""
        everyone = np.arange(len(block.ids))
        if self.pivots is None:
            best = _BestHits(block, k, metric, columns)
            best.add(self.vectors, self.payload, everyone)
            return best, len(everyone), len(everyone)
        distance, off = self.pivots.distances(block.matrix)
        off += self.off
        reach = np.full(len(everyone), np.inf)
        if len(self.pivots.matrix) >= k:
            reach = np.partition(distance, k - 1, axis=1)[:, k - 1] + off
        score = reach * reach if metric == L2 else reach * reach / 2.0 - 1.0
        best = _BestHits(block, k, metric, columns, score + 10.0**-RANK_DECIMALS)
        pairs = len(everyone) * len(self.groups)
        in_reach = distance[:, self.groups] - self.radii <= (reach + off + 1e-7)[:, None]
        if in_reach.sum() > _DENSE_SHARE * pairs:
            self._search_all(best, everyone)
            return best, pairs, pairs
        compared = 0
        # Groups that lie nearest to the block come first, so that later ones meet lower bounds.
        for place in np.argsort(distance[:, self.groups].min(axis=0), kind="stable"):
            bound = best.worst if metric == L2 else 2.0 + 2.0 * best.worst
            reach = np.sqrt(np.maximum(bound, 0.0)) + 2.0 * off + 1e-7
            asked = np.flatnonzero(distance[:, self.groups[place]] - self.radii[place] <= reach)
            compared += len(asked)
            if len(asked):
                rows = slice(self.starts[place], self.starts[place + 1])
                best.add(self.vectors[rows], self.payload.slice(rows.start, rows.stop - rows.start), asked)
        return best, pairs, compared

    def _search_all(self, best: _BestHits, everyone: np.ndarray) -> None:
        """Compare all vectors, in blocks that each hold some of every group, so that the first one bounds the others well."""
        rows = len(self.vectors)
        blocks = -(-rows * len(everyone) // _BLOCK_SCORES)
        for number in range(blocks):
            best.add(self.vectors[number::blocks], self.payload.take(pa.array(np.arange(number, rows, blocks))), everyone)


def _schema(corpus: DataFrame, columns: list[str]) -> T.StructType:
    """Hits, and for every task and slice one row without a query that says how many pairs of query and group were met."""
    fields = [T.StructField("query_id", T.LongType()), T.StructField("score", T.DoubleType())]
    fields += [corpus.schema[name] for name in columns]
    return T.StructType([*fields, T.StructField("pairs", T.LongType()), T.StructField("compared", T.LongType())])


def _pivots(stored: DataFrame, metric: str, count: int) -> dict[int, Pivots]:
    """Some stored vectors by their length. Any will do: they decide what is skipped, never what is found."""
    sample = stored.select("embedding").limit(count).toArrow().column("embedding").combine_chunks()
    lengths = np.unique(pc.list_value_length(sample).to_numpy()) if len(sample) else []
    found = {int(length): _matrix(sample, int(length), metric)[1] for length in lengths if length}
    return {length: Pivots(matrix[: max(1, PIVOT_VALUES // length)]) for length, matrix in found.items() if len(matrix)}


def scan(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str, columns: list[str], slice_queries: int, pivots: int
) -> DataFrame:
    """Candidates of every query from every chunk of the store, written, and the figures of the scan.

    The batch of queries is written to the shared folder in slices, which every task reads through Arrow's file systems.
    """
    spark = corpus.sparkSession
    batch = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    stored = corpus.select("embedding", *columns).where(F.col("embedding").isNotNull())
    dim = batch.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]
    uri = write_slices(batch, max(1, min(slice_queries, SLICE_VALUES // max(1, dim))))
    shared = spark.sparkContext.broadcast(_pivots(stored, metric, pivots) if k else {})
    schema = _schema(corpus, columns)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, values = [], 0
        for one in batches:
            held.append(one)
            values += len(one.column("embedding").flatten())
            if values >= CHUNK_VALUES:
                yield pa.Table.from_batches(held)
                held, values = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def of_chunk(chunk: pa.Table, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        vectors = chunk.column("embedding").combine_chunks()
        payload, known = chunk.select(columns), {}
        for part in read_slices(uri):
            pairs = compared = 0
            for block in QueryBlock.by_length(part, metric):
                length = block.matrix.shape[1]
                if length not in known:
                    found, matrix = _matrix(vectors, length, metric)
                    known[length] = _Chunk.of(matrix, payload.take(pa.array(found)), shared.value.get(length))
                best, met, read = known[length].search(block, k, metric, columns)
                pairs, compared = pairs + met, compared + read
                result = best.result()
                if result:
                    empty = pa.nulls(len(result["score"]), pa.int64())
                    listed = result | {"pairs": empty, "compared": empty}
                    yield from pa.table([listed[name] for name in arrow.names], schema=arrow).to_batches()
            figures = {name: pa.nulls(1, arrow.field(name).type) for name in arrow.names}
            figures |= {"pairs": pa.array([pairs]), "compared": pa.array([compared])}
            yield pa.RecordBatch.from_arrays(list(figures.values()), schema=arrow)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([pa.field(field.name, _ARROW[field.dataType]) for field in schema])
        for chunk in chunks(batches):
            yield from of_chunk(chunk, arrow)

    return materialize(stored.mapInArrow(of_task, schema))


_ARROW = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32()}


def scanned_share(scanned: DataFrame) -> DataFrame:
    """``pairs, compared``: pairs of a query and a group of stored vectors, and those that were not skipped."""
    return scanned.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = L2,
    carry: tuple[str, ...] = ("post_id", "thread_id"),
    slice_queries: int = SLICE_QUERIES,
    scan_tasks: int | None = None,
    pivots: int = PIVOTS,
) -> DataFrame:
    """The ``k`` nearest stored vectors of every query.

    ``queries`` has ``query_id, embedding``; ``corpus`` has ``vec_id, embedding`` and the integer columns named
    in ``carry``. The result adds ``rank`` and either ``distance`` (squared L2, ascending) or ``similarity``
    (cosine, descending). Equal scores rank by ``vec_id``. Vectors without a score (NULL, other length, not
    finite, zero for cosine) are left out, and a query gets fewer than ``k`` rows when fewer exist.

    Each chunk of the scan hands at most ``k`` rows per query to the ranking. ``scan_tasks`` tasks, by default as many as run
    at once, read several splits each, without a shuffle.
    """
    columns = ["vec_id", *carry]
    # Every task hands k rows per query to the ranking, so by default there are no more tasks than can run at once.
    corpus = corpus.coalesce(scan_tasks or corpus.sparkSession.sparkContext.defaultParallelism)
    scanned = scan(queries, corpus, max(k, 0), metric, columns, slice_queries, pivots) if k > 0 else None
    return ranked(scanned, k, metric, columns) if scanned is not None else _nothing(corpus, metric, columns)


def ranked(scanned: DataFrame, k: int, metric: str, columns: list[str]) -> DataFrame:
    """The best candidates of every query, over all chunks."""
    hits = scanned.where(F.col("query_id").isNotNull()).drop("pairs", "compared")
    found = top_per_query(hits, [F.round("score", RANK_DECIMALS), F.col("vec_id")], k)
    name, sign = ("distance", 1) if metric == L2 else ("similarity", -1)
    return found.select("query_id", "rank", *columns, (sign * F.col("score")).alias(name))


def _nothing(corpus: DataFrame, metric: str, columns: list[str]) -> DataFrame:
    name = "distance" if metric == L2 else "similarity"
    blank = corpus.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), *columns, F.lit(0.0).alias(name))
    return blank
