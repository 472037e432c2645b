"""Ranked lexical search over an inverted index whose posting lists are blocked by geometry.

A shard holds some hundred documents: their impacts term by term, and for every term a posting list. Documents of a list
are clustered by the similarity of their impacts, and a block keeps the coordinatewise maximum of its documents' impacts as
a summary. The product of a query and a summary is at least the score of every document of the block, so a block whose
product is below the score that a result needs is skipped, and only such blocks are: results are exact.

Lists that hold much of the shard share one clustering of all its documents, whose blocks are listed under every such term
that one of their documents has. Lists of a few documents are one block without a summary, which is always read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from forumlens.sources.snapshots import materialize, scratch_directory

RESULTS = 20
# Documents and term entries of a shard at most, and terms of a document from which it is a block by itself.
SHARD_DOCUMENTS, SHARD_ENTRIES, WIDE = 1024, 1 << 17, 1024
# Mean documents of a block, documents of a list that needs no summary, the share of a shard's documents from which a list
# takes the shared blocks, and dimensions of the random projection in which documents are clustered.
BLOCK, FEW, SHARED, DIMENSIONS = 32, 24, 1 / 16, 16
# Shards that share a row group of the written index.
SHARDS_TOGETHER = 2
# Entries of the queries that are searched in one pass: a term of an item is one.
QUERY_ENTRIES = 1 << 20
# A NULL key ranks after all others, as this number.
_NO_KEY = 2**63 - 1
_UNBOUNDED = 2**62

# What separates terms (all of ASCII but digits and letters), and A-Z in lower case.
_BYTES = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order, repeats included."""
    return (text or b"").translate(_BYTES).split()


def _listed(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.array(rows, pa.list_(kind))


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, key, terms, times`` of every row; ``item`` numbers the rows."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("key"), F.col(text).alias("text"))
    lists = [T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))]
    schema = T.StructType([numbered.schema["item"], numbered.schema["key"], *lists])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(text.as_py())) for text in batch.column("text").cast(pa.binary())]
            columns = [_listed([list(c) for c in counts], pa.binary()), _listed([list(c.values()) for c in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("key"), *columns], names=schema.names)

    return numbered.mapInArrow(of_batches, schema)


def vectors(documents: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """``document, n, terms, times`` of every document with a term: its asked terms by number, in order, and how many terms
    it has. ``vocabulary`` lists the asked terms."""
    schema = "document long, n long, terms array<int>, times array<bigint>"
    shared = documents.sparkSession.sparkContext.broadcast({term: number for number, term in enumerate(vocabulary)})

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            keys, sizes, terms, times = [], [], [], []
            for document, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = terms_of(value.as_py())
                if found:
                    counts = Counter(found)
                    own = sorted((asked[term], counts[term]) for term in asked.keys() & counts.keys())
                    keys.append(_NO_KEY if document is None else document)
                    sizes.append(len(found))
                    terms.append([number for number, _ in own])
                    times.append([count for _, count in own])
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), _listed(terms, pa.int32()), _listed(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["document", "n", "terms", "times"])

    return documents.select(F.col(key).cast("long"), F.col(text)).mapInArrow(of_batches, schema)


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms."""

    documents: int
    terms: int

    def impacts(self, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term adds to a score for a weight of 1."""
        size = 75 + (25 * n * self.documents) // max(1, self.terms)
        return (1_000_000_000 * times) // (1000 * times + 12 * size)

    def weight(self, documents: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * documents + 1)))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of runs that begin at ``starts``, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class Shard:
    """Documents and blocks. ``document_starts`` cut ``terms`` and ``impacts`` by document, ``member_starts`` cut
    ``members`` by block, ``list_terms`` and ``list_blocks`` pair a term with the blocks of its list, ``summary_terms``,
    ``summary_blocks`` and ``summary_impacts`` are the summaries, ordered by term; the first ``unbounded[0]`` blocks have
    none."""

    documents: np.ndarray
    document_starts: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    member_starts: np.ndarray
    members: np.ndarray
    list_terms: np.ndarray
    list_blocks: np.ndarray
    summary_terms: np.ndarray
    summary_blocks: np.ndarray
    summary_impacts: np.ndarray
    unbounded: np.ndarray

    def candidates(self, asked: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the lists of a query's terms and the bounds that their summaries give, highest first."""
        a, b = np.searchsorted(self.list_terms, asked, "left"), np.searchsorted(self.list_terms, asked, "right")
        blocks = np.unique(self.list_blocks[_runs(a, b - a)])
        a, b = np.searchsorted(self.summary_terms, asked, "left"), np.searchsorted(self.summary_terms, asked, "right")
        places = _runs(a, b - a)
        # Sums of whole numbers below 2 ** 53, which doubles hold exactly.
        products = (np.repeat(weights, b - a) * self.summary_impacts[places]).astype(np.float64)
        bounds = np.bincount(self.summary_blocks[places], products, len(self.member_starts) - 1)[blocks].astype(np.int64)
        bounds[blocks < self.unbounded[0]] = _UNBOUNDED
        order = np.argsort(-bounds, kind="stable")
        return blocks[order], bounds[order]

    def scores(self, documents: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of documents under weights of all terms."""
        starts = self.document_starts[documents]
        sizes = self.document_starts[documents + 1] - starts
        places = _runs(starts, sizes)
        upto = np.concatenate([[0], np.cumsum(weights[self.terms[places]] * self.impacts[places])])
        ends = np.cumsum(sizes)
        return upto[ends] - upto[ends - sizes]


def _points(starts: np.ndarray, terms: np.ndarray, pulls: np.ndarray) -> np.ndarray:
    """Every document as a point of unit length: the sum of a random direction for each term, as long as what the term adds
    to a score."""
    sizes = np.diff(starts)
    points = np.zeros((len(sizes), DIMENSIONS), np.float32)
    if len(terms):
        used, place = np.unique(terms, return_inverse=True)
        directions = _mixed(used)
        filled = np.flatnonzero(sizes)
        points[filled] = np.add.reduceat(directions[place] * pulls.astype(np.float32)[:, None], starts[filled], axis=0)
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)


def _mixed(terms: np.ndarray) -> np.ndarray:
    """Directions that depend on nothing but the term: numbers from -1 to 1 out of mixed bits."""
    x = (terms.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(1, DIMENSIONS + 1, dtype=np.uint64)) * np.uint64(
        0x9E3779B97F4A7C15
    )
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)).astype(np.float32) / 2**23 - 1).astype(np.float32)


def _clusters(points: np.ndarray) -> np.ndarray:
    """The cluster of every document, numbered without gaps: that of the most similar of evenly chosen centres."""
    centres = points[np.linspace(0, len(points) - 1, -(-len(points) // BLOCK)).astype(int)]
    return np.unique(np.argmax(points @ centres.T, axis=1), return_inverse=True)[1]


def build_shard(documents: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray) -> Shard:
    """The shard of documents whose terms and impacts are given one document after the other."""
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(documents)), sizes)
    points = _points(starts, terms, weights[terms] * impacts)
    narrow = sizes < WIDE
    entries = np.flatnonzero(narrow[owner])
    order = entries[np.argsort(terms[entries], kind="stable")]
    listed, first, lengths = np.unique(terms[order], return_index=True, return_counts=True)
    members, list_terms, list_blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    blocks: list[np.ndarray] = [np.zeros(0, np.int64)]
    made = 0

    def put(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Documents as members of new blocks, numbered from 0 without gaps; the numbers that these blocks take."""
        nonlocal made
        order = np.argsort(numbers, kind="stable")
        members.append(rows[order])
        blocks.append(made + numbers[order])
        fresh = made + np.arange(int(numbers.max()) + 1 if len(numbers) else 0)
        made += len(fresh)
        return fresh

    # Short lists: a block each, without a summary.
    short = lengths <= FEW
    own = order[_runs(first[short], lengths[short])]
    list_blocks.append(put(owner[own], np.repeat(np.arange(int(short.sum())), lengths[short])))
    list_terms.append(listed[short])
    unbounded = made
    # Lists of their own clusters.
    frequent = ~short & (lengths > max(FEW, SHARED * len(documents)))
    for term, a, length in zip(*(column[~short & ~frequent].tolist() for column in (listed, first, lengths))):
        rows = owner[order[a : a + length]]
        fresh = put(rows, _clusters(points[rows]))
        list_blocks.append(fresh)
        list_terms.append(np.full(len(fresh), term))
    # Frequent terms list the blocks of one clustering of all documents.
    if frequent.any():
        rows = np.flatnonzero(narrow)
        numbers = _clusters(points[rows])
        fresh = put(rows, numbers)
        cluster = np.zeros(len(documents), np.int64)
        cluster[rows] = numbers
        own = order[_runs(first[frequent], lengths[frequent])]
        pairs = np.unique(np.stack([terms[own], fresh[cluster[owner[own]]]]), axis=1)
        list_terms.append(pairs[0])
        list_blocks.append(pairs[1])
    # A document with very many terms is a block by itself in all its lists.
    alone = np.flatnonzero(~narrow)
    fresh = put(alone, np.arange(len(alone)))
    list_terms.append(terms[_runs(starts[alone], sizes[alone])])
    list_blocks.append(np.repeat(fresh, sizes[alone]))

    members, blocks, list_terms, list_blocks = map(np.concatenate, (members, blocks, list_terms, list_blocks))
    by_term = np.argsort(list_terms, kind="stable")
    member_starts = np.searchsorted(blocks, np.arange(made + 1))
    bounded = int(member_starts[unbounded])
    summaries = _summaries(members[bounded:], blocks[bounded:], starts, sizes, terms, impacts)
    return Shard(
        documents, starts, terms, impacts, member_starts, members, list_terms[by_term], list_blocks[by_term], *summaries,
        np.array([unbounded]),
    )


_AT_ONCE = 1 << 21


def _summaries(members, member_blocks, starts, sizes, terms, impacts):
    """Terms, blocks and coordinatewise maxima of all blocks, by term and block. Entries are sorted some blocks at a time."""
    ends = np.cumsum(sizes[members])
    found, at = [], 0
    while at < len(members):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right"))
        upto = max(upto, at + 1)
        if upto < len(members):  # whole blocks
            whole = int(np.searchsorted(member_blocks, member_blocks[upto], "left"))
            upto = whole if whole > at else int(np.searchsorted(member_blocks, member_blocks[upto], "right"))
        own = members[at:upto]
        places = _runs(starts[own], sizes[own])
        blocks = np.repeat(member_blocks[at:upto], sizes[own])
        # One number for block, term and impact, each with room for its largest value.
        packed = (blocks << 42) | (terms[places].astype(np.int64) << 20) | impacts[places]
        packed.sort()
        last = packed[np.flatnonzero(np.append(np.diff(packed >> 20) != 0, True))] if len(packed) else packed
        found.append(((last >> 20) & ((1 << 22) - 1), last >> 42, last & ((1 << 20) - 1)))
        at = upto
    term, block, impact = (np.concatenate([part[i] for part in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(term, kind="stable")
    return term[order], block[order], impact[order]


_FIELDS = tuple(Shard.__dataclass_fields__)
INDEX = ", ".join(f"{name} array<{'bigint' if name == 'documents' else 'int'}>" for name in _FIELDS)


def build_index(rows: DataFrame, corpus: Corpus, weights: np.ndarray) -> DataFrame:
    """Shards of ``vectors``, one row each. Documents join the shard of their task as they come; a shard is full at a number
    of documents or entries, so its size is bounded, and no posting list leaves its shard, however frequent its term."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def shard(parts: list[tuple]) -> pa.RecordBatch:
        documents, n, sizes, terms, times = (np.concatenate(column) for column in zip(*parts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        impacts = corpus.impacts(times, np.repeat(n, sizes))
        made = build_shard(documents, starts, terms, impacts, shared.value)
        kinds = {name: (np.int64, pa.int64()) if name == "documents" else (np.int32, pa.int32()) for name in _FIELDS}
        lists = [pa.array([getattr(made, name).astype(kind)], pa.list_(arrow)) for name, (kind, arrow) in kinds.items()]
        return pa.RecordBatch.from_arrays(lists, names=_FIELDS)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, entries = [], 0, 0
        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy()).astype(np.int64)
            columns = [batch.column(name).to_numpy() for name in ("document", "n")]
            terms, times = (batch.column(name).flatten().to_numpy().astype(np.int64) for name in ("terms", "times"))
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                before = int(ends[at - 1]) if at else 0
                upto = min(at + SHARD_DOCUMENTS - documents, int(np.searchsorted(ends, before + SHARD_ENTRIES - entries, "right")))
                if upto > at or not held:
                    upto = min(len(sizes), max(upto, at + 1))
                    first, last = before, int(ends[upto - 1])
                    held.append((columns[0][at:upto], columns[1][at:upto], sizes[at:upto], terms[first:last], times[first:last]))
                    documents, entries, at = documents + upto - at, entries + last - first, upto
                if at < len(sizes):
                    yield shard(held)
                    held, documents, entries = [], 0, 0
        if held:
            yield shard(held)

    return rows.mapInArrow(of_batches, INDEX)


def write_index(shards: DataFrame, directory: str) -> DataFrame:
    """Write shards and read them back. A shard is a large row, so that few of them may share a row group."""
    shards.write.mode("errorifexists").option("parquet.block.row.count.limit", SHARDS_TOGETHER).parquet(directory)
    return shards.sparkSession.read.schema(shards.schema).parquet(directory)


@dataclass
class Query:
    """An item's terms by number, and their weights times their repeats."""

    item: int
    terms: np.ndarray
    weights: np.ndarray


class Best:
    """The best results of every query so far: score, and less the key."""

    def __init__(self, queries: list[Query], results: int, vocabulary: int):
        self.queries, self.results, self.vocabulary = queries, results, vocabulary
        self.found: list[list[tuple[int, int]]] = [[] for _ in queries]
        self.blocks = self.read = 0

    def add(self, shard: Shard) -> None:
        """Search one shard. The best blocks come first, and the search ends at the first block below what is needed."""
        weights = np.zeros(self.vocabulary, np.int64)
        for query, found in zip(self.queries, self.found):
            blocks, bounds = shard.candidates(query.terms, query.weights)
            self.blocks += len(blocks)
            weights[query.terms] = query.weights
            seen = np.zeros(len(shard.documents), bool)
            at, step = 0, 4
            while at < len(blocks):
                needed = max(1, found[0][0] if len(found) == self.results else 1)
                step = min(step, int(np.searchsorted(-bounds[at:], -needed, "right")))
                if not step:
                    break
                chosen = blocks[at : at + step]
                sizes = shard.member_starts[chosen + 1] - shard.member_starts[chosen]
                members = np.unique(shard.members[_runs(shard.member_starts[chosen], sizes)])
                members = members[~seen[members]]
                seen[members] = True
                self._keep(found, shard.documents[members], shard.scores(members, weights))
                at, step = at + step, 2 * step
            self.read += at
            weights[query.terms] = 0

    def _keep(self, found: list[tuple[int, int]], documents: np.ndarray, scores: np.ndarray) -> None:
        chosen = np.flatnonzero(scores >= max(1, found[0][0] if len(found) == self.results else 1))
        if len(chosen) > self.results:
            chosen = chosen[np.lexsort((documents[chosen], -scores[chosen]))[: self.results]]
        for score, document in zip(scores[chosen].tolist(), documents[chosen].tolist()):
            entry = (score, -document)
            if len(found) < self.results:
                heapq.heappush(found, entry)
            elif entry > found[0]:
                heapq.heapreplace(found, entry)


def search_index(index: DataFrame, queries: list[Query], vocabulary: int, results: int) -> DataFrame:
    """``item, document, score``: of every task the best results of each query, kept from shard to shard, so that later
    shards of a task skip more."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, results, vocabulary)
        for batch in batches:
            for row in range(batch.num_rows):
                best.add(Shard(*(batch.column(name)[row].values.to_numpy().astype(np.int64) for name in _FIELDS)))
        for query, found in zip(best.queries, best.found):
            if found:
                columns = [[query.item] * len(found), [-document for _, document in found], [score for score, _ in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "document", "score"])

    return index.mapInArrow(of_batches, "item long, document long, score long")


def search(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", results: int = RESULTS, query_entries: int = QUERY_ENTRIES,
) -> DataFrame:
    """The best documents of every row of ``items``: ``item, rank, key, score``.

    Terms are runs of digits, letters A-Z in either case, and characters beyond ASCII. A term weighs by its rareness, a
    document by how often it has the term against its length; scores are whole numbers, equal ones rank by the key, a NULL
    key last. Documents without a common term, and those that score 0, are no results. Rows that repeat an item or a
    document are items and documents of their own; NULL and empty texts have no terms; other columns are not carried.

    ``key`` is a whole number. Queries of at most ``query_entries`` terms travel to the tasks at a time, and as many passes
    over the documents follow each other as it takes; every pass writes its vectors, its index and its results.
    """
    spark = documents.sparkSession
    asked = materialize(query_terms(items, item, item_text))
    entries = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    passes = max(1, -(-entries // query_entries))
    found = None
    for number in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).select("item", "terms", "times").toArrow()
        vocabulary = sorted(set(own.column("terms").combine_chunks().flatten().to_pylist()))
        rows = materialize(vectors(documents, vocabulary, key, text))
        totals = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        corpus = Corpus(*totals)
        holding = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("documents")).toArrow()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, many in zip(holding.column("term").to_pylist(), holding.column("documents").to_pylist()):
            weights[term] = corpus.weight(many)
        places = {term: place for place, term in enumerate(vocabulary)}
        queries = []
        for row, terms, times in zip(*(own.column(name).to_pylist() for name in ("item", "terms", "times"))):
            numbers = np.array([places[term] for term in terms], np.int64)
            order = np.argsort(numbers)
            queries.append(Query(row, numbers[order], weights[numbers[order]] * np.array(times, np.int64)[order]))
        index = write_index(build_index(rows, corpus, weights), scratch_directory(spark))
        hits = materialize(search_index(index, queries, len(vocabulary), results))
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "document")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= results)
    document = F.when(F.col("document") != _NO_KEY, F.col("document"))
    return ranked.join(asked.select("item", F.col("key").alias("asked_key")), "item").select(
        F.col("asked_key").alias(item), "rank", document.alias(key), "score"
    )
