"""Minimal perfect hashing of whole numbers: n keys take the slots 0 to n - 1, each its own.

Keys are dealt to segments by a mix of their bits, so that every segment is built by itself, in its own task. Inside a
segment a key takes the place that the first level's hash gives it if no other key wants that place; the others go on to
the next level. A key's slot is the number of taken places before its own. Nothing in the places tells a stranger from a
key, so the keys are kept by slot and compared.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Places a level has for each of its keys, mean keys of a segment, and levels after which building gives up.
ROOM, SEGMENT_KEYS, MOST_LEVELS = 2, 1 << 15, 64
_WORD = 64


def mix(keys: np.ndarray, number: int) -> np.ndarray:
    """Keys as well-spread 64-bit numbers, other ones for every ``number``."""
    x = keys.astype(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segments of keys; ``segments`` is a power of two."""
    return (mix(keys, -1) & np.uint64(segments - 1)).astype(np.int64)


@dataclass
class Segment:
    """One segment: places of each level, bits of taken places, and the keys by slot."""

    sizes: np.ndarray
    words: np.ndarray
    keys: np.ndarray


def build_segment(keys: np.ndarray) -> Segment:
    """A segment of different keys."""
    rest, sizes, words, ordered = keys.astype(np.int64), [], [], [np.empty(0, np.int64)]
    while len(rest):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("keys repeat")
        size = -(-ROOM * len(rest) // _WORD) * _WORD
        place = (mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size)[place] == 1
        taken = np.zeros(size, bool)
        taken[place[alone]] = True
        sizes.append(size)
        words.append(np.packbits(taken, bitorder="little").view("<u8"))
        ordered.append(rest[alone][np.argsort(place[alone])])
        rest = rest[~alone]
    joined = np.concatenate(words) if words else np.empty(0, np.uint64)
    return Segment(np.array(sizes, np.int64), joined.astype(np.uint64), np.concatenate(ordered))


class PerfectHash:
    """Slots of keys, over all segments in order."""

    def __init__(self, segments: Iterable[Segment]):
        parts = list(segments)
        self.segments = len(parts)
        levels = max((len(part.sizes) for part in parts), default=0)
        self.sizes = np.zeros((self.segments, levels), np.int64)
        self.starts = np.zeros((self.segments, levels), np.int64)
        at = 0
        for number, part in enumerate(parts):
            self.sizes[number, : len(part.sizes)] = part.sizes
            self.starts[number, : len(part.sizes)] = at + np.concatenate([[0], np.cumsum(part.sizes)[:-1]]) if len(part.sizes) else 0
            at += int(part.sizes.sum())
        self.words = np.concatenate([np.empty(0, np.uint64), *(part.words for part in parts)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.concatenate([np.empty(0, np.int64), *(part.keys for part in parts)])
        # Slots of a segment follow those of the segments before it.
        self.first = np.concatenate([[0], np.cumsum([len(part.keys) for part in parts], dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 for numbers that are no key."""
        found = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys)) if len(self.keys) else np.empty(0, np.int64)
        segment = segment_of(keys, self.segments) if len(self.keys) else None
        for level in range(self.sizes.shape[1]):
            sizes = self.sizes[segment[rest], level]
            rest, sizes = rest[sizes > 0], sizes[sizes > 0]
            if not len(rest):
                break
            place = (mix(keys[rest], level) % sizes.astype(np.uint64)).astype(np.int64) + self.starts[segment[rest], level]
            word, bit = self.words[place // _WORD], (place % _WORD).astype(np.uint64)
            taken = ((word >> bit) & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[rest[taken]] = (self.before[place // _WORD] + below)[taken]
            rest = rest[~taken]
        known = found >= 0
        known[known] = self.keys[found[known]] == keys[known]
        return np.where(known, found, -1)


SEGMENTS = "segment int, sizes binary, words binary, keys binary"


def segment_count(keys: int, mean: int = SEGMENT_KEYS) -> int:
    """The power of two that leaves a segment about ``mean`` keys."""
    return 1 << max(0, (max(keys, 1) - 1) // mean).bit_length()


def build(keys: DataFrame, segments: int) -> DataFrame:
    """The segments of ``key`` (long), different and not NULL, one row each; segments without keys have no row.

    A segment is a group of about ``SEGMENT_KEYS`` keys, whatever the keys are, since a mix of their bits deals them.
    """
    def deal(batches):
        for batch in batches:
            numbers = segment_of(batch.column(0).to_numpy(), segments).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers)], names=["key", "segment"])

    def of_group(group: pa.Table) -> pa.Table:
        made = build_segment(np.sort(group.column("key").to_numpy()))
        row = {"segment": group.column("segment")[0].as_py()}
        row |= {name: getattr(made, name).tobytes() for name in ("sizes", "words", "keys")}
        return pa.Table.from_pylist([row], pa.schema({"segment": pa.int32(), "sizes": pa.binary(), "words": pa.binary(), "keys": pa.binary()}))

    return keys.select("key").mapInArrow(deal, "key long, segment int").groupBy("segment").applyInArrow(of_group, SEGMENTS)


def load(rows: pa.Table, segments: int) -> PerfectHash:
    """The hash of the rows of :func:`build`."""
    found = {}
    for row in rows.to_pylist():
        sizes, keys = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["keys"], np.int64)
        found[row["segment"]] = Segment(sizes, np.frombuffer(row["words"], np.uint64), keys)
    nothing = build_segment(np.empty(0, np.int64))
    return PerfectHash(found.get(number, nothing) for number in range(segments))
