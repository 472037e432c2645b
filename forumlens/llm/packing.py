"""Packing of tokenized documents into few sequences by a configuration linear program.

The program has one row per piece length and one column per way to fill a sequence (a pattern). It sees nothing of the
corpus but the histogram of lengths, whose size is bounded by the capacity, and is solved by multiplicative weights: a
length's weight falls as it gets covered, and the next pattern is the best knapsack under the weights, found by dynamic
programming. The solution is rounded down, what is left is solved again, and the last pieces go by best fit into open
sequences. Pieces then take the places of their length by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from forumlens.llm.ranks import numbered
from forumlens.llm.spaced_words import SpacedWords, words_of

CAPACITY = 1024
END_ID = 2

# The program: pricing rounds, patterns drawn for each length and round, multiplicative updates of a round, how fast
# weights follow, how often a drawn pattern ends with an exact piece, the share of free room, and the ids that rounding may
# take from a pattern.
ROUNDS, DRAWS, UPDATES, RATE, FINISH, FREE_ROOM, DROPPED = 3, 30, 400, 0.5, 0.7, 0.0002, 16

# Bytes of words and ids that a worker remembers, and what a word takes besides them. Longer words are not kept.
_KEPT, _WORD_BYTES, _LONGEST = 96 << 20, 200, 64
# Bytes of texts that are encoded at a time.
_AT_ONCE = 1 << 21

Plan = list[tuple[tuple[int, ...], int]]


class _Tokens:
    """Ids of texts as little-endian bytes, as the tokenizer alone gives them.

    Byte-pair merges never cross a place before a single space that stands between words, so the ids of a text are those of
    its first word and of the words after a space, one after the other; known words need not be encoded again. A text that
    holds a control token's string is encoded whole.
    """

    def __init__(self, merges: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.spaced = SpacedWords(merges, ranks)
        self.plain = Tokenizer.from_file(merges)
        self.controls = [token.content.encode() for token in self.plain.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.held = 0

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that are not empty."""
        if self.held > _KEPT:
            self.words, self.held = {}, 0
        cut = [None if any(control in text for control in self.controls) else words_of(text) for text in texts]
        found = self._known(list(set(chain.from_iterable(words[1:] for words in cut if words)) - self.words.keys()))
        heads = [text.decode() if words is None else words[0] for text, words in zip(texts, cut)]
        firsts = self.plain.encode_batch(heads, add_special_tokens=False)
        known = self.words if not found else _Both(found, self.words)
        return [
            np.array(first.ids, "<u4").tobytes() + (b"".join(map(known.__getitem__, words[1:])) if words else b"")
            for first, words in zip(firsts, cut)
        ]

    def _known(self, new: list[str]) -> dict[str, bytes]:
        """Remember new words; returns those that are too long to be kept."""
        if not new:
            return {}
        words, ids, counts = self.spaced.ids(new)
        joined, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        long = {}
        for word, a, b in zip(words, [0, *ends[:-1]], ends):
            (self.words if len(word) <= _LONGEST else long)[word] = joined[a:b]
        self.held += _WORD_BYTES * len(words) + len(joined)
        return long


class _Both(dict):
    """Words of one batch, and behind them those that are kept."""

    def __init__(self, own: dict[str, bytes], kept: dict[str, bytes]):
        super().__init__(own)
        self.kept = kept

    def __missing__(self, word: str) -> bytes:
        return self.kept[word]


@cache
def _tokens(merges: str, ranks: str | None) -> _Tokens:
    """One per worker process, so that what it knows outlives a task."""
    return _Tokens(merges, ranks)


def _portions(texts: list[bytes]) -> Iterator[slice]:
    """Slices of a batch of texts of bounded size, one text at least."""
    start = size = 0
    for place, text in enumerate(texts):
        if size > _AT_ONCE:
            yield slice(start, place)
            start, size = place, 0
        size += len(text)
    yield slice(start, len(texts))


def pieces(
    rows: DataFrame, tokenizer: str, key: str, text: str, capacity: int = CAPACITY, end: int = END_ID, ranks: str | None = None
) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every piece of every row.

    A document is its ids and ``end``; NULL counts as the empty text, which is ``end`` alone. A document longer than
    ``capacity`` is cut into pieces of ``capacity``, of which the first may be shorter. ``tokenizer`` is a path that
    exists on every machine, as is ``ranks``, the same vocabulary for the quicker library.
    """
    schema = T.StructType([
        rows.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    last = np.array([end], "<u4").tobytes()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer, ranks)
        for batch in batches:
            texts = [one or b"" for one in batch.column(1).cast(pa.binary()).to_pylist()]
            for portion in _portions(texts):
                yield cut(batch.column(0), portion.start, texts[portion], tokens)

    def cut(keys: pa.Array, start: int, texts: list[bytes], tokens: _Tokens) -> pa.RecordBatch:
        found, encoded = [], iter(tokens.of([text for text in texts if text]))
        for row, text in enumerate(texts, start):
            ids = (next(encoded) if text else b"") + last
            total = len(ids) // 4
            first = total % capacity or capacity
            edges = [0, *range(first, total + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                found.append((row, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
        places, *columns = zip(*found) if found else [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(places, pa.int64())), *map(pa.array, columns, kinds)], names=schema.names
        )

    return rows.select(F.col(key), F.col(text)).mapInArrow(of_batches, schema)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The largest total price that fits each room from 0 to ``capacity``, any number of copies allowed."""
    value = np.zeros(capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if fitting[room]:
            value[room] = max(value[room], (value[room - lengths[: fitting[room]]] + prices[: fitting[room]]).max())
    return value


class _Pricing:
    """Patterns of nearly the best price, drawn from the table of the knapsack."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, mass: np.ndarray, capacity: int, slack: float):
        self.lengths, self.prices, self.mass, self.capacity = lengths, prices, mass, capacity
        self.value = knapsack(lengths, prices, capacity)
        self.slack = slack * self.value[capacity]
        self.fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")

    def pattern(self, seed: int, random: np.random.Generator) -> tuple[int, ...] | None:
        """Places of lengths that fill a sequence together with the seed; None if the seed is not worth its price."""
        room = self.capacity - int(self.lengths[seed])
        loss = self.value[self.capacity] - self.value[room] - self.prices[seed]
        chosen = [seed]
        while loss <= self.slack and self.fitting[room]:
            upto = self.fitting[room]
            if self.lengths[upto - 1] == room and random.random() < FINISH:
                chosen.append(int(upto - 1))  # a piece that ends the sequence; few pieces leave the short ones over
                return tuple(sorted(chosen))
            less = self.value[room] - self.value[room - self.lengths[:upto]] - self.prices[:upto]
            allowed = np.flatnonzero(less <= self.slack - loss)
            if not len(allowed):
                break
            shares = np.cumsum(self.mass[allowed])
            place = int(allowed[np.searchsorted(shares, random.random() * shares[-1])])
            loss += max(less[place], 0.0)
            chosen.append(place)
            room -= int(self.lengths[place])
        return tuple(sorted(chosen)) if loss <= self.slack else None


def solve(demand: dict[int, int], capacity: int, random: np.random.Generator) -> dict[tuple[tuple[int, int], ...], float]:
    """How often each pattern, as (length, copies), is used by a fractional solution that covers the demand.

    Every round prices the lengths by their weights, adds patterns of nearly the best price for each length, and
    repeats the multiplicative update: a pattern's use grows with the demand over the coverage of its lengths. Lengths
    that stay covered too little gain weight for the next round. Free room is a length of one id with a small demand.
    """
    listed = sorted(demand)
    lengths = np.array([1, *listed])
    counts = np.array([0.0, *(float(demand[length]) for length in listed)])
    volume = float((lengths * counts).sum())
    counts[0] = FREE_ROOM * volume
    weights = np.ones(len(lengths))
    patterns: dict[tuple[int, ...], int] = {}
    used = np.empty(0)
    for round_number in range(ROUNDS):
        pricing = _Pricing(lengths, lengths * weights, lengths * counts, capacity, 0.01 if round_number else 1e-9)
        for seed in range(1, len(lengths)):
            for _ in range(DRAWS):
                found = pricing.pattern(seed, random)
                if found is not None:
                    patterns.setdefault(found, len(patterns))
        rows = np.concatenate([np.array(found) for found in patterns])
        columns = np.repeat(np.arange(len(patterns)), [len(found) for found in patterns])
        size = np.bincount(columns, lengths[rows])
        even = volume / capacity / len(patterns)
        used = np.concatenate([used, np.full(len(patterns) - len(used), even)])
        for _ in range(UPDATES):
            lack = counts / np.maximum(np.bincount(rows, used[columns], len(lengths)), 1e-12)
            used *= np.bincount(columns, lengths[rows] * lack[rows]) / size
        weights *= np.clip(lack, 0.5, 2.0) ** RATE
    solution: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    for found, times in zip(patterns, used.tolist()):
        copies: dict[int, int] = defaultdict(int)
        for place in found:
            copies[int(lengths[place])] += place > 0
        solution[tuple(sorted((length, many) for length, many in copies.items() if many))] += times
    return solution


def plan(demand: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences as (lengths, how many of them) that hold exactly ``demand`` (pieces by length)."""
    rest = {length: count for length, count in demand.items() if count}
    groups: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = capacity - sum(lengths)
        groups[room][lengths] = groups[room].get(lengths, 0) + times

    if rest.get(capacity):  # full pieces have sequences of their own
        put((capacity,), rest.pop(capacity))
    random = np.random.default_rng(0)
    solution = solve(rest, capacity, random) if rest else {}
    for pattern, times in sorted(solution.items(), key=lambda found: (-found[1], found[0])):
        # Fractions are rounded at random, so that the sum of many small ones is kept.
        wanted, dropped = int(times) + int(random.random() < times % 1), 0
        while wanted and pattern:
            fits = min(wanted, *(rest[length] // copies for length, copies in pattern))
            if fits:
                put(tuple(length for length, copies in reversed(pattern) for _ in range(copies)), fits)
                for length, copies in pattern:
                    rest[length] -= fits * copies
                wanted -= fits
            if wanted:
                # Nothing is left of a length: go on without it if it is short, the room is filled below.
                lacking = next((length, copies) for length, copies in pattern if rest[length] < copies)
                dropped += lacking[0] * lacking[1]
                if dropped > DROPPED:
                    break
                pattern = tuple(part for part in pattern if part != lacking)
    _best_fit({length: count for length, count in rest.items() if count}, capacity, groups)
    return [(lengths, times) for found in groups.values() for lengths, times in sorted(found.items()) if times]


def _best_fit(rest: dict[int, int], capacity: int, open_groups: dict[int, dict[tuple[int, ...], int]]) -> None:
    """Longest pieces first, each into the fullest sequences that take it; equal sequences move together."""
    rooms = sorted(room for room, groups in open_groups.items() if groups)

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = capacity - sum(lengths)
        if not open_groups[room]:
            place = bisect_right(rooms, room)
            if not place or rooms[place - 1] != room:
                rooms.insert(place, room)
        open_groups[room][lengths] = open_groups[room].get(lengths, 0) + times

    for length in sorted(rest, reverse=True):
        count = rest[length]
        while count:
            place = bisect_right(rooms, length - 1)
            if place == len(rooms):
                many = max(1, min(count, capacity // length))
                times = count // many
                put((length,) * many, times)
                count -= many * times
                continue
            groups = open_groups[rooms[place]]
            if not groups:
                rooms.pop(place)
                continue
            lengths, times = groups.popitem()
            taken = min(times, count)
            if taken < times:
                groups[lengths] = times - taken
            put((*lengths, length), taken)
            count -= taken


class Places:
    """Where the piece of a given rank among its length goes."""

    def __init__(self, planned: Plan):
        runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        sequence = 0
        for lengths, times in planned:
            offset = 0
            copies = {length: lengths.count(length) for length in sorted(set(lengths))}
            for length, many in copies.items():
                runs[length].append((ranks[length], sequence, many, offset))
                ranks[length] += times * many
                offset += length * many
            sequence += times
        self.runs = {length: np.array(listed, np.int64) for length, listed in runs.items()}
        self.sequences = sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            listed = self.runs[int(size)]
            first, start, many, base = listed[np.searchsorted(listed[:, 0], rank[rows], side="right") - 1].T
            inside = rank[rows] - first
            sequence[rows] = start + inside // many
            offset[rows] = base + inside % many * size
        return sequence, offset


def pack(
    rows: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str | None = None
) -> DataFrame:
    """Every piece as ``key, piece, start, length, ids_crc32, sequence_id, offset``.

    Sequences are numbered from 0 and hold at most ``capacity`` ids; offsets are gapless from 0. Repeated rows are
    documents of their own, NULL texts are empty documents, a NULL key stays NULL, no rows give no pieces. Other
    columns are not carried.
    """
    cut = numbered(pieces(rows, tokenizer, key, text, capacity, ranks=ranks), "length", [key, "piece", "start"], "rank")
    demand = {row["length"]: row["pieces"] for row in cut.groupBy("length").agg(F.count("*").alias("pieces")).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(Places(plan(demand, capacity)))
    kept = cut.select(key, "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*kept.schema.fields[:-1], *added])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = shared.value.of(length, rank)
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(of_batches, schema)
