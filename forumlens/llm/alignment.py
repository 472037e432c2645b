"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the whole corpus.

A first pass aligns all texts and counts id pairs. The distinct pairs get a minimal perfect hash, every task's counts become
a dense vector indexed by it, and the vectors are summed in a tree. A second pass aligns the texts again and looks the
counts of its pairs up by slot, with the pair itself compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from forumlens.llm import perfect_hash
from forumlens.llm.perfect_hash import PerfectHash
from forumlens.llm.spaced_words import SpacedWords, words_of
from forumlens.sources.snapshots import materialize

# Up to so many distinct pairs, hash, counts and keys travel to the tasks: 25 bytes a pair and some bits. Beyond, pairs
# meet their counts by shuffle.
BROADCAST_PAIRS = 1 << 22
# Dense vectors that are added at a time, and how many of them every core may make.
FAN, VECTORS_A_CORE = 16, 4
# Bytes of parts and alignments that a worker remembers, and what a part takes besides its texts and pairs.
_KEPT, _PART_BYTES = 128 << 20, 300
# Bytes of texts that are aligned at a time, and pairs that a task counts before it hands them on.
_BYTES_AT_ONCE, _COUNTED = 1 << 21, 1 << 21

_WORD_MARK = "\u2581"


class _Numbers(dict):
    """Numbers of parts; a part that is not there gets the next number and is listed as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class AlignedParts:
    """Alignments of parts of texts by number, as far as they are remembered.

    ``counts`` holds the tokens of either tokenizer, groups and links of each part; ``good`` whether the bytes of its tokens
    are its own; ``groups`` the written groups; ``pairs`` the id pairs of its links, which begin at ``starts``.
    """

    def __init__(self, merges: str, ranks: str, pieces: str, writes: bool = True):
        import sentencepiece

        self.first = SpacedWords(merges, ranks)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.first_bytes = self.first.bytes
        self.second_bytes = [self._piece(number) for number in range(self.second.get_piece_size())]
        self.first_sizes = self.first.sizes
        self.second_sizes = np.array(list(map(len, self.second_bytes)), np.int64)
        # Every number three times: before another one of its side, before the other side, before the next group.
        self.most = max(len(self.first_sizes), len(self.second_sizes))
        self.names = pa.array([f"{number}{mark}".encode() for mark in ",|;" for number in range(self.most)], pa.large_binary())
        self.writes = writes
        self.forget()

    def _piece(self, number: int) -> bytes:
        piece = self.second.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(number) else piece.replace(_WORD_MARK, " ").encode()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.counts, self.good = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.groups: list[bytes] = []
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.held = 0

    def __len__(self) -> int:
        return len(self.good)

    @property
    def full(self) -> bool:
        return self.held > _KEPT

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the parts of texts that are not empty, one after the other, and where each text begins."""
        listed = [words_of(text) for text in texts]
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        found = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(listed)), np.int64, int(sizes.sum()))
        known, new = len(self), self.numbers.new
        if new:
            self.numbers.new = []
            self._add(new)
            # The numbers that the new parts got in the end, in the order in which they were met.
            last = np.fromiter(map(self.numbers.__getitem__, new), np.int64, len(new))
            fresh = found >= known
            found[fresh] = last[found[fresh] - known]
        return found, np.cumsum(sizes) - sizes

    def _add(self, words: list[str]) -> None:
        words, first, first_counts = self.first.ids(words)
        encoded = self.second.encode(words, num_threads=1)
        second_counts = np.fromiter(map(len, encoded), np.int64, len(words))
        second = np.fromiter(chain.from_iterable(encoded), np.int64, int(second_counts.sum()))
        texts = [b" " + word.encode() for word in words]
        good = np.ones(len(words), bool)
        whole = b"".join(texts)
        first_bytes, second_bytes = self.first_bytes, self.second_bytes
        same = b"".join(map(second_bytes.__getitem__, second.tolist())) == whole
        if not same or b"".join(map(first_bytes.__getitem__, first.tolist())) != whole:
            a, b = np.cumsum(first_counts), np.cumsum(second_counts)
            for place, text in enumerate(texts):
                mine = first[a[place] - first_counts[place] : a[place]], second[b[place] - second_counts[place] : b[place]]
                joined = b"".join(first_bytes[i] for i in mine[0].tolist()), b"".join(second_bytes[i] for i in mine[1].tolist())
                good[place] = joined == (text, text)
            first, second = first[np.repeat(good, first_counts)], second[np.repeat(good, second_counts)]
        part_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) * good)
        counts, groups, keys, starts = self._aligned(first, second, part_ends, good)
        counts[:, 0], counts[:, 1] = first_counts * good, second_counts * good
        at = len(self)
        self.numbers.update(zip(words, range(at, at + len(words))))
        self.counts, self.good = np.concatenate([self.counts, counts]), np.concatenate([self.good, good])
        self.groups += groups
        self.starts = np.concatenate([self.starts, len(self.pairs) + starts])
        self.pairs = np.concatenate([self.pairs, keys])
        self.held += _PART_BYTES * len(words) + len(whole) + sum(map(len, groups)) + 8 * len(keys)

    def _aligned(self, first: np.ndarray, second: np.ndarray, part_ends: np.ndarray, good: np.ndarray):
        """Counts, written groups and pairs of good parts, whose tokens follow each other.

        Between two neighbouring ends of tokens lie bytes of exactly one token of each side, and all bytes that these two
        share: every such stretch is a link.
        """
        ends, other_ends = np.cumsum(self.first_sizes[first]), np.cumsum(self.second_sizes[second])
        both = np.sort(np.concatenate([ends, other_ends]), kind="stable")  # two runs, which a stable sort merges
        again = both[1:] == both[:-1]
        stretches, cuts = both[np.append(~again, True)] if len(both) else both, both[1:][again]
        keys = (first[np.searchsorted(ends, stretches)] << 32) | second[np.searchsorted(other_ends, stretches)]
        numbered = np.flatnonzero(good)
        of_link = numbered[np.searchsorted(part_ends[numbered], stretches)]
        of_group = numbered[np.searchsorted(part_ends[numbered], cuts)]
        counts = np.zeros((len(good), 4), np.int64)
        counts[:, 2] = np.bincount(of_group, minlength=len(good))
        counts[:, 3] = np.bincount(of_link, minlength=len(good))
        return counts, self._written(first, second, ends, other_ends, cuts, counts[:, 2]), keys, np.cumsum(counts[:, 3])

    def _written(self, first, second, ends, other_ends, cuts, group_counts: np.ndarray) -> list[bytes]:
        """The groups of every part as text, if this aligner writes them."""
        if not self.writes:
            return []
        if not len(cuts):
            return [b""] * len(group_counts)
        a_ends, b_ends = np.searchsorted(ends, cuts) + 1, np.searchsorted(other_ends, cuts) + 1
        a_sizes, b_sizes = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        # The numbers of a group's first side stand before those of its second.
        a_places = np.arange(len(first)) + np.repeat(b_ends - b_sizes, a_sizes)
        b_places = np.arange(len(second)) + np.repeat(a_ends, b_sizes)
        named = np.empty(len(first) + len(second), np.int64)
        named[a_places], named[b_places] = first, second
        named[a_places[a_ends - 1]] += self.most
        named[b_places[b_ends - 1]] += 2 * self.most
        taken = self.names.take(pa.array(named))
        places, text = np.frombuffer(taken.buffers()[1], np.int64), taken.buffers()[2].to_pybytes()
        group_ends = np.append(0, places[a_ends + b_ends])
        last = np.cumsum(group_counts)
        starts, stops = group_ends[last - group_counts], group_ends[last] - (group_counts > 0)
        return [text[x:y] for x, y in zip(starts.tolist(), stops.tolist())]

    def pairs_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of numbered parts, one after the other, and how many each has."""
        sizes = self.counts[numbers, 3]
        total = int(sizes.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.pairs[np.repeat(self.starts[numbers], sizes) + inside], sizes


@lru_cache(maxsize=1)
def _parts(merges: str, ranks: str, pieces: str, writes: bool) -> AlignedParts:
    """One per worker process and pass, so that what it knows outlives a task."""
    return AlignedParts(merges, ranks, pieces, writes)


@dataclass(frozen=True)
class Tokenizers:
    """Files of the two tokenizers, at the same place on every machine: merges and ranks of the first, pieces of the second."""

    merges: str
    ranks: str
    pieces: str

    def parts(self, writes: bool) -> AlignedParts:
        return _parts(self.merges, self.ranks, self.pieces, writes)


def _portions(texts: list[bytes | None]) -> Iterator[slice]:
    """Slices of a batch of texts of bounded length, one text at least."""
    start = size = 0
    for place, text in enumerate(texts):
        if size > _BYTES_AT_ONCE:
            yield slice(start, place)
            start, size = place, 0
        size += len(text or b"")
    yield slice(start, len(texts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of values; a run goes up to the next start."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[np.append(starts[1:], len(values))] - upto[starts]


def pair_counts(rows: DataFrame, tokenizers: Tokenizers, text: str) -> DataFrame:
    """``key, n``: how often every task met an id pair in a link. A pair has a row for each task that met it, or a few."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = tokenizers.parts(writes=False)
        used, keys, counts = np.zeros(len(parts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            met = np.flatnonzero(used)
            pairs, sizes = parts.pairs_of(met)
            return _summed(np.concatenate([keys, pairs]), np.concatenate([counts, np.repeat(used[met], sizes)]))

        for batch in batches:
            texts = [one for one in batch.column(0).cast(pa.binary()).to_pylist() if one]
            for portion in _portions(texts):
                if parts.full:
                    keys, counts = gathered()
                    parts.forget()
                    used = np.zeros(0, np.int64)
                    if len(keys) > _COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                numbers, starts = parts.number(texts[portion])
                whole = _sums(~parts.good[numbers], starts) == 0
                numbers = numbers[np.repeat(whole, np.diff(np.append(starts, len(numbers))))]
                used = np.concatenate([used, np.zeros(len(parts) - len(used), np.int64)])
                used += np.bincount(numbers, minlength=len(used))
        keys, counts = gathered()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return rows.select(text).mapInArrow(of_batches, "key long, n long")


def dense_sums(counts: DataFrame, segments: DataFrame, segment_number: int, vectors: int, fan: int = FAN) -> DataFrame:
    """``key, count`` of all keys of a perfect hash, from the ``key, n`` of many tasks.

    Every task adds what it reads to a dense vector over all slots and hands it on by segments; at most ``vectors`` tasks
    do. Vectors are added ``fan`` at a time, level by level, so no task gets more than ``fan`` vectors of one segment.
    """
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(perfect_hash.load(segments.toArrow(), segment_number))
    schema = "segment int, part int, counts binary"

    def vector_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        vector = np.zeros(len(known), np.int64)
        for batch in batches:
            keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            np.add.at(vector, known.slots(keys), n)
        part = TaskContext.get().partitionId()
        for number in range(known.segments):
            own = vector[known.first[number] : known.first[number + 1]]
            if own.any():
                columns = [pa.array([number], pa.int32()), pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "part", "counts"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(one, np.int64) for one in group.column("counts").to_pylist())
        columns = [group.column("segment")[:1], pa.chunked_array([pa.array([group.column("part")[0].as_py() // fan], pa.int32())])]
        return pa.table([*columns, pa.array([total.tobytes()], pa.binary())], names=["segment", "part", "counts"])

    rows = counts.coalesce(vectors).mapInArrow(vector_of_task, schema)
    while vectors > 1:
        rows = rows.groupBy("segment", F.floor(F.col("part") / fan).alias("level")).applyInArrow(lambda _, group: added(group), schema)
        vectors = -(-vectors // fan)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sums in zip(batch.column("keys"), batch.column("counts")):
                columns = [pa.array(np.frombuffer(one.as_py(), np.int64)) for one in (keys, sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "count"])

    return rows.join(segments, "segment").select("keys", "counts").mapInArrow(listed, "key long, count long")


def corpus_counts(counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS, fan: int = FAN) -> tuple[DataFrame, PerfectHash | None]:
    """``key, count, best`` of all pairs, written, and their perfect hash if they are few enough to travel.

    ``best`` tells that no pair with the same second id has a higher count.
    """
    distinct = materialize(counts.select("key").distinct())
    total = distinct.count()
    known = None
    if total <= broadcast_pairs:
        number = perfect_hash.segment_count(total)
        segments = materialize(perfect_hash.build(distinct, number))
        known = perfect_hash.load(segments.toArrow(), number)
        sums = dense_sums(counts, segments, number, VECTORS_A_CORE * counts.sparkSession.sparkContext.defaultParallelism, fan)
    else:
        sums = counts.groupBy("key").agg(F.sum("n").alias("count"))
    sums = materialize(sums).withColumn("second", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = sums.groupBy("second").agg(F.max("count").alias("highest"))
    found = sums.join(highest, "second").select("key", "count", (F.col("count") == F.col("highest")).alias("best"))
    return materialize(found), known


def _second_pass(rows: DataFrame, tokenizers: Tokenizers, key: str, text: str, looked_up) -> DataFrame:
    """Figures of every row; ``looked_up`` is a broadcast of hash, counts and bests, or None to return the pairs instead."""
    names = ["n_a", "n_b", "n_groups", "n_links"]
    fields = [rows.schema[key], *(T.StructField(name, T.LongType()) for name in names)]
    listed = T.ArrayType(T.LongType())
    last = ("n_best", T.LongType()), ("count_sum", T.LongType())
    if looked_up is None:
        last = ("pairs", listed), ("times", listed)
    fields += [T.StructField(name, kind) for name, kind in last] + [T.StructField("groups_sha256", T.StringType())]
    schema = T.StructType(fields)

    def figures_of(parts: AlignedParts, start: int) -> np.ndarray:
        """Links with a best count and summed counts of the parts from a number on."""
        known, counts, best = looked_up.value
        pairs, sizes = parts.pairs_of(np.arange(start, len(parts)))
        slots = known.slots(pairs)
        begins = np.cumsum(sizes) - sizes
        return np.stack([_sums(best[slots].astype(np.int64), begins), _sums(counts[slots], begins)], axis=1)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, more = tokenizers.parts(writes=True), np.zeros((0, 2), np.int64)
        for batch in batches:
            listed = batch.column(1).cast(pa.binary()).to_pylist()
            for portion in _portions(listed):
                texts = listed[portion]
                if parts.full:
                    parts.forget()
                    more = more[:0]
                full = [place for place, one in enumerate(texts) if one]
                numbers, starts = parts.number([texts[place] for place in full])
                ends = np.append(starts[1:], len(numbers))
                figures = np.zeros((len(texts), 6), np.int64)
                digests, pairs, times = [""] * len(texts), [[]] * len(texts), [[]] * len(texts)
                if looked_up is not None and len(more) < len(parts):
                    more = np.concatenate([more, figures_of(parts, len(more))])
                good = _sums(~parts.good[numbers], starts) == 0
                each = parts.counts[numbers] if looked_up is None else np.hstack([parts.counts[numbers], more[numbers]])
                upto = np.concatenate([np.zeros((1, each.shape[1]), np.int64), np.cumsum(each, axis=0)])
                figures[np.array(full, np.int64), : each.shape[1]] = (upto[ends] - upto[starts]) * good[:, None]
                groups, flat = parts.groups, numbers.tolist()
                for place, a, b, kept in zip(full, starts.tolist(), ends.tolist(), good.tolist()):
                    if kept:
                        digests[place] = hashlib.sha256(b";".join([groups[i] for i in flat[a:b]])).hexdigest()
                        if looked_up is None:
                            own, _ = parts.pairs_of(numbers[a:b])
                            pairs[place], times[place] = _summed(own, np.ones(len(own), np.int64))
                own_key = batch.column(0)[portion.start : portion.stop]
                columns = [own_key, *(pa.array(figures[:, place]) for place in range(4))]
                if looked_up is None:
                    columns += [pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
                else:
                    columns += [pa.array(figures[:, place]) for place in (4, 5)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=schema.names)

    return rows.select(F.col(key), F.col(text)).mapInArrow(of_batches, schema)


def align(
    rows: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Every row as ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A text after a space is tokenized by both. Byte places where tokens of both end cut it into groups; a link is a pair of
    tokens that share bytes. The count of an id pair is the number of links that it has in all rows: ``n_best`` counts a
    row's links of which no other pair with the same second id has a higher count, ``count_sum`` adds their counts. Rows
    whose text is NULL or empty, or whose joined token bytes differ from the text, have no tokens: zeros, and an empty
    digest. Repeated rows count each; other columns are not carried; no rows give no rows.
    """
    counts = materialize(pair_counts(rows, tokenizers, text))
    found, known = corpus_counts(counts, broadcast_pairs)
    if known is not None:
        table = found.toArrow()
        slots = known.slots(table.column("key").to_numpy())
        # One more place, which slot -1 of pairs that no row of this table has points to.
        count, best = np.zeros(len(known) + 1, np.int64), np.zeros(len(known) + 1, bool)
        count[slots], best[slots] = table.column("count").to_numpy(), table.column("best").to_numpy()
        return _second_pass(rows, tokenizers, key, text, rows.sparkSession.sparkContext.broadcast((known, count, best)))
    listed = _second_pass(rows, tokenizers, key, text, None).withColumn("row", F.monotonically_increasing_id())
    listed = materialize(listed)
    each = listed.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("key"), F.col("times").alias("times")))).join(found, "key")
    sums = each.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return listed.join(sums, "row", "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
