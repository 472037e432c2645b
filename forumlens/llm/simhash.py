"""SimHash near-duplicates: fingerprints, pigeonhole blocks, a join on blocks, a check of the Hamming distance.

Copies collapse first: linking works on distinct fingerprints. A table of the pigeonhole scheme is a choice of
fingerprint bits; fingerprints that agree on them meet in a bucket. Inside a bucket every task finds the linked
groups exactly and returns a tree of links for each, never all pairs; buckets beyond a bound are cut into chunks
of which every two meet, so no task gets more than two chunks however large a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from forumlens.llm.components import components
from forumlens.sources.snapshots import materialize

SEED = 42
# A bucket with more fingerprints is cut into chunks of about so many.
CHUNK = 2048
# The lossless scheme takes narrow tables as long as buckets stay below this mean size.
MEAN_BUCKET = 256
# Buckets up to this size are compared by shifting the sorted rows, larger ones by a search from row to row.
_SMALL = 16
_SHINGLES_AT_ONCE = 1 << 14
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

Tables = list[list[int]]


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a UTF-8 text, repeats included, in arrays of bounded length.

    Words are runs without ASCII white space, A-Z in lower case, joined by one space. Fewer words than a shingle
    has make one shingle; no words make none.
    """
    found = text.translate(_LOWER).split()
    if not found:
        return
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :][:count]
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, _SHINGLES_AT_ONCE):
        part = slice(at, min(at + _SHINGLES_AT_ONCE, count))
        spans = zip(starts[part].tolist(), last[part].tolist())
        yield np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, part.stop - part.start)


def _widened(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Hashes as bytes of ``lanes`` 64-bit numbers: the hash itself, then mixes of it."""
    wide = np.empty((len(hashes), lanes), np.uint64)
    wide[:, 0] = hashes
    for lane in range(1, lanes):
        x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        wide[:, lane] = x ^ (x >> np.uint64(31))
    return wide.astype(">u8").view(np.uint8)


def fingerprint(text: bytes | None, words: int, bits: int) -> bytes:
    """A bit is 1 if it is set in over half of the shingle hashes. No words give the zero fingerprint."""
    votes, total = np.zeros(bits, np.int64), 0
    for hashes in shingle_hashes(text or b"", words):
        set_bits = np.unpackbits(_widened(hashes, bits // 64), axis=1)
        total += len(hashes)
        for at in range(0, len(hashes), 255):  # sums of 255 bits fit in a byte
            votes += np.add.reduce(set_bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > total).tobytes()


def fingerprints(rows: DataFrame, key: str, text: str, words: int, bits: int) -> DataFrame:
    """``key, fingerprint`` (binary, most significant bit first) of every row; NULL texts have no words."""
    schema = T.StructType([rows.schema[key], T.StructField("fingerprint", T.BinaryType())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = pa.array([fingerprint(t.as_py(), words, bits) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=[key, "fingerprint"])

    return rows.select(F.col(key), F.col(text)).mapInArrow(of_batches, schema)


def lossless_tables(bits: int, distance: int, count: int) -> Tables:
    """Bit choices of which any two fingerprints within ``distance`` agree on at least one.

    The fingerprint is cut into ``distance + k`` blocks; at least ``k`` of them are free of differences, so the
    tables are all choices of ``k`` blocks. ``k`` grows with the number of fingerprints, so that buckets stay small.
    """
    for k in range(1, 5):
        edges = np.linspace(0, bits, distance + k + 1).round().astype(int)
        blocks = [list(range(a, b)) for a, b in zip(edges[:-1], edges[1:])]
        tables = [sum(chosen, []) for chosen in combinations(blocks, k)]
        if count <= MEAN_BUCKET * 2 ** min(map(len, tables)):
            break
    return tables


def disjoint_tables(bits: int, width: int) -> Tables:
    """Consecutive blocks of ``width`` bits."""
    return [list(range(at, at + width)) for at in range(0, bits, width)]


def _buckets(nodes: DataFrame, tables: Tables) -> DataFrame:
    """One row per table for every node: ``bucket_table, bucket_key, node, fingerprint``."""
    schema = "bucket_table int, bucket_key long, node long, fingerprint binary"
    names = ["bucket_table", "bucket_key", "node", "fingerprint"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(_bytes(batch.column("fingerprint")), axis=1)
            for number, chosen in enumerate(tables):
                keys = bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64))
                places = pa.array(np.full(len(keys), number, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [places, pa.array(keys), batch.column("node"), batch.column("fingerprint")], names=names
                )

    return nodes.select("node", "fingerprint").mapInArrow(of_batches, schema)


def _bytes(column: pa.Array) -> np.ndarray:
    """A column of equally long binaries as rows of bytes."""
    if not len(column):
        return np.empty((0, 8), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _links_of_bucket(nodes: np.ndarray, words: np.ndarray, distance: int) -> tuple[list, list]:
    """A tree of links for every linked group of one bucket."""
    left, right = [], []
    rest = np.arange(len(nodes))
    while len(rest):
        root, rest, open_rows = rest[0], rest[1:], [rest[0]]
        while open_rows and len(rest):
            row = open_rows.pop()
            near = np.bitwise_count(words[rest] ^ words[row]).sum(axis=1) <= distance
            found, rest = rest[near], rest[~near]
            left.append(np.full(len(found), nodes[root]))
            right.append(nodes[found])
            open_rows.extend(found.tolist())
    return left, right


def _links(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside all buckets of rows sorted by bucket; ``keys`` numbers the buckets."""
    words = np.ascontiguousarray(prints).view(np.uint64)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(np.append(first, len(keys)))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= _SMALL), sizes))
    for lag in range(1, _SMALL):
        a, b = small[:-lag], small[lag:]
        same = keys[a] == keys[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= distance
        left.append(nodes[a[near]])
        right.append(nodes[b[near]])
    for bucket in np.flatnonzero(sizes > _SMALL):
        rows = slice(first[bucket], first[bucket] + sizes[bucket])
        more = _links_of_bucket(nodes[rows], words[rows], distance)
        left.extend(more[0])
        right.extend(more[1])
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame, distance: int, tables: Tables, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between nodes (``node`` long, ``fingerprint``) of at most ``distance`` differing bits.

    Not all pairs: the links connect what all pairs inside the buckets connect.
    """
    buckets = _buckets(nodes, tables)
    sizes = buckets.groupBy("bucket_table", "bucket_key").agg(F.count("*").alias("bucket_size"))
    large = sizes.where(F.col("bucket_size") > chunk).select(
        "bucket_table", "bucket_key", F.ceil(F.col("bucket_size") / chunk).cast("int").alias("chunks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.least("own", other) * F.col("chunks") + F.greatest("own", other),
    )
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(met)
    rows = buckets.join(materialize(large), ["bucket_table", "bucket_key"], "left").withColumn("own", own)
    place = ["bucket_table", "bucket_key", "cell"]
    rows = rows.select("bucket_table", "bucket_key", F.explode(cells).alias("cell"), "node", "fingerprint")
    rows = rows.repartition(*place).sortWithinPartitions(*place)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = _numbers(table)
            cut = int(np.searchsorted(last, last[-1])) if len(last) else 0
            held = table.slice(cut).combine_chunks()  # the last bucket may go on in the next batch
            yield from found(table.slice(0, cut))
        if held is not None:
            yield from found(held)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows > 1:
            fingerprints_of = _bytes(table.column("fingerprint").combine_chunks())
            a, b = _links(_numbers(table), table.column("node").to_numpy(), fingerprints_of, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(of_batches, "a long, b long")


def _numbers(table: pa.Table) -> np.ndarray:
    """Numbers of the buckets of sorted rows, from 0."""
    changed = np.zeros(table.num_rows, bool)
    for name in ("bucket_table", "bucket_key", "cell"):
        values = table.column(name).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.cumsum(changed)


def near_duplicates(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 4,
    bits: int = 64,
    distance: int = 4,
    tables: Tables | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Every row as ``key, fingerprint, component_id``.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the least key reachable over
    links, a row's own included. Without ``tables`` the scheme loses no link. With ``tables`` only fingerprints that
    agree on one of them are compared. Rows of equal text, repeated rows included, are one component; NULL, empty
    and blank texts have the zero fingerprint. A NULL key never is the least one while another exists. Other
    columns are not carried; no rows give no rows.
    """
    prints = materialize(fingerprints(rows, key, text, words, bits))
    distinct = prints.groupBy("fingerprint").agg(F.min(key).alias("least_key"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    scheme = tables or lossless_tables(bits, distance, nodes.count())
    labels = materialize(components(links(nodes, distance, scheme, chunk)))
    linked = nodes.join(labels, "node")
    least = linked.groupBy("label").agg(F.min("least_key").alias("component_id"))
    linked = linked.join(least, "label").select("node", "component_id")
    known = nodes.join(linked, "node", "left")
    known = known.select("fingerprint", F.coalesce("component_id", "least_key").alias("component_id"))
    return prints.join(materialize(known), "fingerprint").select(key, "fingerprint", "component_id")
