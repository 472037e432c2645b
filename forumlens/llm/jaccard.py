"""Near-duplicates by the exact Jaccard similarity of shingle sets.

Minimum hashes only find candidates: sets whose minima agree on a band meet in a bucket, and what their minima have in common
tells inside the task which of them may be similar. Candidates that hang together form a family, however loosely; the whole
sets of a family meet in cells of bounded size and are compared there. Tasks return trees of links, never pairs, so a family
of any size and any number of similarities costs work inside tasks but no rows. Equal sets collapse first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from forumlens.llm.components import components
from forumlens.llm.simhash import shingle_hashes
from forumlens.sources.snapshots import materialize

# A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: all but 3 of a million at 0.8.
BANDS, ROWS = 32, 5
# Sets of a pair of similarity s share a minimum with probability s. A pair stays a candidate if its share of equal minima is
# not more than so many standard errors below the similarity that is asked for: all but one of 500 million at 0.8.
DEVIATIONS = 6.0
# A bucket or a family beyond so many sets is cut into chunks, of which every two meet in a cell.
BUCKET_CHUNK, FAMILY_CHUNK = 1024, 128
_COLUMNS = 1 << 14
_AT_ONCE = 1 << 12
_DRAWN = np.random.default_rng(42)
_MASKS = _DRAWN.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_FACTORS = _DRAWN.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted."""
    parts = list(shingle_hashes(text or b"", words))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under every hash function."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), _AT_ONCE):
        np.minimum(least, ((high[at : at + _AT_ONCE, None] ^ _MASKS) * _FACTORS).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """The buckets of a set with these minima."""
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), number) - (1 << 63) for number, row in enumerate(rows)]


def _prints(rows: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``key, digest, n, minima`` of every row: what identifies its set, its size and its minima; no minima without words."""
    schema = T.StructType([
        rows.schema[key], T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("minima", T.BinaryType()),
    ])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, least = [], [], []
            for value in batch.column(1).cast(pa.binary()):
                found = shingle_set(value.as_py(), words)
                digests.append(digest(found))
                sizes.append(len(found))
                least.append(minima(found).tobytes() if len(found) else None)
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(least, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "digest", "n", "minima"])

    return rows.select(F.col(key), F.col(text)).mapInArrow(of_batches, schema)


def _buckets(nodes: DataFrame) -> DataFrame:
    """``node, bucket`` for every band of every node."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bands(np.frombuffer(one.as_py(), np.uint32)) for one in batch.column("minima")]
            numbers = np.repeat(batch.column("node").to_numpy(), BANDS)
            flat = np.array(found, np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(flat)], names=["node", "bucket"])

    return nodes.where(F.col("minima").isNotNull()).select("node", "minima").mapInArrow(of_batches, "node long, bucket long")


def _met(rows: DataFrame, group: str, chunk: int) -> DataFrame:
    """Rows (``group, node``) of groups of two and more, with ``cell``: a group beyond ``chunk`` rows is cut, and a row goes to
    the cells in which its part meets each part."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("members")).where(F.col("members") > 1)
    parts = sizes.select(group, F.ceil(F.col("members") / chunk).cast("int").alias("parts"))
    rows = rows.join(materialize(parts), group).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.least("own", other) * F.col("parts") + F.greatest("own", other),
    )
    return rows.select(group, "node", F.explode(met).alias("cell"))


def _trees(rows: DataFrame, group: str, links: Callable[[np.ndarray, list], tuple[list, list]]) -> DataFrame:
    """Links ``a, b`` of rows (``group, cell, node`` and one more column), cell by cell, as ``links`` finds them."""
    placed = rows.repartition(group, "cell").sortWithinPartitions(group, "cell")
    content = [name for name in rows.columns if name not in (group, "cell", "node")][0]

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [table.column(name).to_numpy() for name in (group, "cell")]
        changed = np.zeros(table.num_rows, bool)
        for values in keys:
            changed[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(np.append(True, changed[1:])) if table.num_rows else np.zeros(0, np.int64)
        nodes, contents = table.column("node").to_numpy(), table.column(content)
        left, right = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            if b - a > 1:
                more = links(nodes[a:b], contents.slice(a, b - a))
                left += more[0]
                right += more[1]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = [table.column(name).to_numpy() for name in (group, "cell")]
            same = (last[0] == last[0][-1]) & (last[1] == last[1][-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = table.slice(cut).combine_chunks()  # the last cell may go on in the next batch
            if cut:
                yield from found(table.slice(0, cut).combine_chunks())
        if held is not None:
            yield from found(held)

    return placed.mapInArrow(of_batches, "a long, b long")


def _forest(nodes: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list, list]:
    """A tree for each group of nodes that hang together: ``near`` tells which of some places are linked to a place."""
    left, right, rest = [], [], np.arange(len(nodes))
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        waiting = [root]
        while waiting and len(rest):
            place = waiting.pop()
            linked = near(place, rest)
            found, rest = rest[linked], rest[~linked]
            left += [int(nodes[place])] * len(found)
            right += nodes[found].tolist()
            waiting += found.tolist()
    return left, right


def _alike(similarity: float) -> Callable:
    """Links of sets whose minima have so much in common that their similarity may be enough."""
    every = BANDS * ROWS
    least = similarity * every - DEVIATIONS * (every * similarity * (1 - similarity)) ** 0.5

    def links(nodes: np.ndarray, contents: pa.Array) -> tuple[list, list]:
        rows = np.frombuffer(b"".join(contents.to_pylist()), np.uint32).reshape(len(nodes), every)
        return _forest(nodes, lambda place, rest: (rows[rest] == rows[place]).sum(axis=1) >= least)

    return links


def _similar(similarity: float) -> Callable:
    """Links of sets of at least this similarity."""

    def links(nodes: np.ndarray, contents: pa.Array) -> tuple[list, list]:
        lists = [np.frombuffer(one, np.uint64) for one in contents.to_pylist()]
        common = common_sizes(lists)
        sizes = np.array([len(one) for one in lists])

        def near(place: int, rest: np.ndarray) -> np.ndarray:
            return common[place, rest] >= similarity * (sizes[rest] + sizes[place] - common[place, rest])

        return _forest(nodes, near)

    return links


def common_sizes(lists: list[np.ndarray]) -> np.ndarray:
    """How many members every two sets have in common."""
    sizes = np.array([len(one) for one in lists])
    flat = np.concatenate(lists)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # what one set alone has is in common with none
    column = np.full(len(times), -1, np.int64)
    column[shared] = np.arange(len(shared))
    rows, columns = np.repeat(np.arange(len(lists)), sizes), column[place]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(lists), len(lists)))
    for start in range(0, len(shared), _COLUMNS):
        a, b = np.searchsorted(columns, [start, start + _COLUMNS])
        held = np.zeros((len(lists), min(_COLUMNS, len(shared) - start)), np.float32)
        held[rows[a:b], columns[a:b] - start] = 1
        common += held @ held.T
    return common


def _sets(rows: DataFrame, nodes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``node, family, shingles`` of ``nodes`` (``node, family, least_key``), from the rows that they stand for."""
    chosen = rows.select(F.col(key).alias("own"), F.col(text).alias("text"))
    chosen = chosen.join(nodes, chosen["own"] == nodes["least_key"]).select("node", "family", "text")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(one.as_py(), words).tobytes() for one in batch.column("text").cast(pa.binary())]
            columns = [batch.column("node"), batch.column("family"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "family", "shingles"])

    return chosen.mapInArrow(of_batches, "node long, family long, shingles binary")


def _gathered(nodes: DataFrame, key: str, close: DataFrame) -> DataFrame:
    """Links ``a, b`` from every node with words to the first of its group in ``close`` (``key, component_id``)."""
    grouped = nodes.where(F.col("minima").isNotNull()).select("node", F.col("least_key").alias(key))
    grouped = materialize(grouped.join(close.select(key, "component_id"), key).select("node", "component_id"))
    first = grouped.groupBy("component_id").agg(F.min("node").alias("a"))
    return grouped.join(first, "component_id").where(F.col("a") < F.col("node")).select("a", F.col("node").alias("b"))


def near_duplicates(
    rows: DataFrame, key: str, text: str = "text", words: int = 5, similarity: float = 0.8, close: DataFrame | None = None
) -> DataFrame:
    """Every row as ``key, component_id``; ``key`` numbers the rows and is unique.

    ``close`` (``key, component_id``) are groups that another method found: their members are candidates as well, and stay
    linked only if their sets are similar enough.

    Rows link if the Jaccard similarity of their sets of word shingles is at least ``similarity``; ``component_id`` is
    the least key reachable over links, a row's own included. Rows of equal sets, and all texts without words (NULL, empty,
    blank), are one component. Other columns are not carried; no rows give no rows.
    """
    prints = materialize(_prints(rows, key, text, words))
    distinct = prints.groupBy("digest").agg(F.min(key).alias("least_key"), F.first("minima").alias("minima"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))

    met = materialize(_met(_buckets(nodes), "bucket", BUCKET_CHUNK))
    candidates = met.join(nodes.select("node", "minima"), "node")
    trees = _trees(candidates, "bucket", _alike(similarity))
    trees = trees if close is None else trees.unionByName(_gathered(nodes, key, close))
    families = materialize(components(trees)).withColumnRenamed("label", "family")

    sets = materialize(_sets(rows, nodes.join(families, "node").select("node", "family", "least_key"), key, text, words))
    cells = _met(sets.select("family", "node"), "family", FAMILY_CHUNK)
    links = _trees(cells.join(sets.select("node", "shingles"), "node"), "family", _similar(similarity))
    labels = materialize(components(links))

    linked = nodes.join(labels, "node")
    least = linked.groupBy("label").agg(F.min("least_key").alias("component_id"))
    linked = linked.join(least, "label").select("node", "component_id")
    found = nodes.join(linked, "node", "left")
    found = found.select("digest", F.coalesce("component_id", "least_key").alias("component_id"))
    return prints.select(key, "digest").join(materialize(found), "digest").select(key, "component_id")
