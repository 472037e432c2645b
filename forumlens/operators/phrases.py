"""Where phrases stand in posts, from the postings of their words.

Postings meet by post and field. A task holds some posts at a time and goes through them word by word, along a tree of the
phrases' words: it looks only at places where a phrase has begun, so the work grows with the words of the posts and not
with the phrases that share a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from forumlens.sources.snapshots import read_slices, write_slices

# Phrases of a slice, and postings and places that a task holds at once, beyond those of one post.
SLICE_PHRASES, CHUNK_POSTINGS, CHUNK_PLACES = 1 << 17, 1 << 18, 1 << 21

_HELD = ("term", "span", "field", "post_id", "date", "length", "positions")
_FOUND = "phrase string, span bigint, field int, post_id bigint, date bigint, length int, times bigint"


@dataclass(frozen=True)
class Phrases:
    """A slice of phrases as a tree. Level n has the sorted keys of its nodes, made of the node above and the word at place
    n, and the number of the phrase that ends in a node, or -1."""

    texts: pa.Array
    vocabulary: pa.Array
    levels: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: pa.Table) -> Phrases:
        """Of ``phrase, words``; every phrase is there once."""
        lists = rows.column("words").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy().astype(np.int64)
        node, levels = np.zeros(len(sizes), np.int64), []
        for place in range(sizes.max(initial=0)):
            longer = np.flatnonzero(sizes > place)
            keys, node[longer] = np.unique(node[longer] * len(encoded.dictionary) + codes[starts[longer] + place], return_inverse=True)
            ends = np.full(len(keys), -1)
            last = longer[sizes[longer] == place + 1]
            ends[node[last]] = last
            levels.append((keys, ends))
        return Phrases(rows.column("phrase").combine_chunks(), encoded.dictionary, levels)


def _steps(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Nodes of a level by their keys, -1 where there is none."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Places:
    """Postings of whole posts, sorted by post and field, and every place of their words in text order."""

    def __init__(self, rows: pa.Table):
        self.rows, self.terms = rows, rows.column("term").combine_chunks().dictionary_encode()
        self.term = self.terms.indices.to_numpy().astype(np.int64)
        self.text = np.append(0, np.cumsum(_changes(rows)))
        lists = rows.column("positions").combine_chunks()
        self.sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        place = lists.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(rows.num_rows), self.sizes)
        # Where a field of a post has several postings of one word, as if the post came twice, they are part of no longer phrase.
        _, same, often = np.unique(self.text * len(self.terms.dictionary) + self.term, return_inverse=True, return_counts=True)
        alone = (often == 1)[same][row]
        key = (self.text[row] * (place.max(initial=0) + 2) + place)[alone]
        order = np.argsort(key, kind="stable")
        key, self.row = key[order], row[alone][order]
        self.next, self.end = np.searchsorted(key, key + 1), np.searchsorted(key, key + 1, side="right")

    def found(self, phrases: Phrases) -> pa.Table:
        """``phrase`` and fields of the posting of its first word, for every field of a post where it stands, and how many ``times``."""
        known = pc.index_in(self.terms.dictionary, value_set=phrases.vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        of_row = known[self.term]
        (keys, ends), *deeper = phrases.levels
        # Phrases of one word are their postings.
        node = np.where(of_row >= 0, _steps(keys, of_row), -1)
        rows = np.flatnonzero((node >= 0) & (ends[node] >= 0))
        numbers, listed, times = [ends[node[rows]]], [rows], [self.sizes[rows]]
        begun, code = node[self.row], of_row[self.row]
        at = first = np.flatnonzero(begun >= 0)
        node = begun[at]
        for keys, ends in deeper:
            many = self.end[at] - self.next[at]
            own = np.repeat(np.arange(len(at)), many)
            after = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + self.next[at][own]
            step = np.where(code[after] >= 0, _steps(keys, node[own] * len(phrases.vocabulary) + code[after]), -1)
            on = step >= 0
            at, first, node = after[on], first[own[on]], step[on]
            whole = ends[node] >= 0
            row = self.row[first[whole]]
            texts = int(self.text[-1]) + 1
            pairs, one, count = np.unique(ends[node[whole]] * texts + self.text[row], return_index=True, return_counts=True)
            numbers, listed, times = [*numbers, pairs // texts], [*listed, row[one]], [*times, count]
        taken = self.rows.drop_columns(["term", "positions"]).take(pa.array(np.concatenate(listed)))
        texts = phrases.texts.take(pa.array(np.concatenate(numbers)))
        return taken.append_column("phrase", texts).append_column("times", pa.array(np.concatenate(times), pa.int64()))


def _changes(rows: pa.Table) -> np.ndarray:
    """Where a row belongs to another post or field than the row before it."""
    post, field = (rows.column(name).to_numpy() for name in ("post_id", "field"))
    return (np.diff(post) != 0) | (np.diff(field) != 0)


def _chunks(batches: Iterator[pa.RecordBatch], most_postings: int, most_places: int) -> Iterator[pa.Table]:
    """Rows of whole posts, some at a time."""
    held, postings, places = [], 0, 0
    for batch in batches:
        held.append(batch)
        postings, places = postings + batch.num_rows, places + len(batch.column("positions").flatten())
        if postings >= most_postings or places >= most_places:
            rows = pa.Table.from_batches(held)
            cuts = np.flatnonzero(_changes(rows))
            if len(cuts):
                yield rows.slice(0, cuts[-1] + 1)
                rows = rows.slice(cuts[-1] + 1)
            held, postings, places = rows.to_batches(), 0, 0
    if held:
        yield pa.Table.from_batches(held)


def standing(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase, span, field, post_id, date, length, times``: fields of posts where a phrase stands.

    ``postings`` are those of the words of ``phrases`` (``phrase, words``), each of which is there once. Tasks read the
    phrases from the shared folder slice by slice.
    """
    uri = write_slices(phrases.select("phrase", "words"), SLICE_PHRASES)
    limits = CHUNK_POSTINGS, CHUNK_PLACES

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Phrases.of(part) for part in islice(read_slices(uri), 2)]
        names = [name.split()[0] for name in _FOUND.split(", ")]
        for chunk in _chunks(batches, *limits):
            places = Places(chunk)
            for part in kept if len(kept) < 2 else map(Phrases.of, read_slices(uri)):
                if part.levels:
                    yield from places.found(part).select(names).to_batches()

    dealt = postings.select(*_HELD).repartition("post_id", "field").sortWithinPartitions("post_id", "field")
    return dealt.mapInArrow(of_task, _FOUND)
