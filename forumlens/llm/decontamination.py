"""Benchmark decontamination: a broadcast hash set of normalised item n-grams meets the token windows of documents.

Words are runs of ``0-9``, ``a-z`` and non-ASCII characters after A-Z in lower case. A window is ``n`` consecutive
words of an item; an item with fewer, but some, words is one window. Items travel to the tasks in slices of a bounded
number of windows; a larger benchmark is scanned slice after slice within the same pass, so nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Windows of one slice: with ten 32-bit numbers for each, and words shared by neighbours, some hundred megabytes at most.
SLICE_WINDOWS = 1 << 20

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of a UTF-8 text: letters in lower case, everything that is no part of a word a space. Lengths stay.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_FOUND = "struct<spans:array<struct<start:int,stop:int>>,items:array<string>,n_words:bigint,n_hit:bigint,cut_text:string>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD_PATTERN), F.lit(0))


def item_windows(items: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (as text, NULL as empty), ``words``: one row per window of every item that has words."""
    found = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    each = found.where(F.size("words") > 0).select("item", "words", F.explode(starts).alias("start"))
    return each.select("item", F.slice("words", F.col("start"), F.lit(n)).alias("words"))


@dataclass
class WindowSet:
    """A hash set of windows by length, over numbered words."""

    numbers: dict[bytes, int]
    hashes: dict[int, np.ndarray]
    owners: dict[bytes, list[str]]

    @staticmethod
    def of(rows: pa.Table) -> WindowSet:
        numbers: dict[bytes, int] = {}
        owners: dict[bytes, list[str]] = {}
        found: dict[int, list[np.ndarray]] = {}
        for item, listed in zip(rows.column("item").to_pylist(), rows.column("words").to_pylist()):
            window = np.array([numbers.setdefault(w.encode(), len(numbers) + 1) for w in listed], np.int32)
            names = owners.setdefault(window.tobytes(), [])
            if not names:
                found.setdefault(len(window), []).append(window)
            if not names or names[-1] != item:
                names.append(item)
        hashes = {size: np.sort(_rolling(np.concatenate(parts), size)[::size]) for size, parts in found.items()}
        return WindowSet(numbers, hashes, owners)

    def hits(self, found: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """Start, length and items of every window of a document that is in the set."""
        ids = np.fromiter(map(self.numbers.get, found, repeat(0)), np.int32, len(found))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, known in self.hashes.items():
            if size > len(ids):
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if len(starts):
                values = _rolling(ids, size)[starts]
                places = np.minimum(np.searchsorted(known, values), len(known) - 1)
                for start in starts[known[places] == values].tolist():
                    owners = self.owners.get(ids[start : start + size].tobytes())
                    if owners:
                        yield start, size, owners


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every ``size`` consecutive numbers."""
    values = np.zeros(len(ids) - size + 1, np.uint64)
    for place in range(size):
        values = values * _BASE + ids[place : place + len(values)].astype(np.uint64)
    return values


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    return [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]


def _cut(text: bytes, spelled: bytes, found: list[bytes], spans: list[dict[str, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    starts, at = [], 0
    for word in found:
        at = spelled.index(word, at)
        starts.append(at)
        at += len(word)
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : starts[span["start"]]])
        last = span["stop"] - 1
        at = starts[last] + len(found[last])
    return b"".join([*kept, text[at:]])


def scan(
    rows: DataFrame,
    items: DataFrame,
    carry: list[str],
    text: str = "text",
    n: int = 10,
    item: str = "item_id",
    item_text: str = "text",
    cut: bool = False,
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """Every row as ``source`` (a struct of the ``carry`` columns), ``n_words, n_hit, spans, items, cut_text``.

    A word inside any occurrence of an item's window is hit; ``spans`` are the runs of hit words (``start``, ``stop``
    exclusive, counted in words from 0), ``items`` the items with occurring windows, in no order. ``cut_text`` is, where
    ``cut`` asks for it, the text without its spans, else NULL. NULL and empty texts have no words and stay as they
    are; repeated items and rows are scanned like any others; without items nothing is hit. Columns that are not
    carried are left out, so no name can clash.
    """
    spark = rows.sparkSession
    windows = item_windows(items, n, item, item_text)
    slices = max(1, -(-windows.count() // slice_windows))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(slices))
    # A carried text is read from the row that carries it.
    source, own_text = F.struct(*carry).alias("source"), [] if text in carry else [F.col(text).alias("scanned")]
    scanned = F.col("source")[text] if text in carry else F.col("scanned")
    found = rows.select(source, *own_text, F.lit(None).cast(_FOUND).alias("found"))
    for number in range(slices):
        own = windows.where(part == number) if slices > 1 else windows
        shared = spark.sparkContext.broadcast(WindowSet.of(own.toArrow()))
        last = number == slices - 1
        # Of a row, only its text goes to Python, once a slice, and none comes back but a cut one. Marked nondeterministic, so
        # that no filter on what is found repeats the call.
        passed = F.arrow_udf(_scanner(shared, cut and last), _FOUND).asNondeterministic()
        found = found.withColumn("found", passed(scanned, F.col("found")))
    return found.select("source", *[f"found.{name}" for name in ("n_words", "n_hit", "spans", "items", "cut_text")])


def _scanner(shared, cut: bool):
    kinds = {
        "spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
        "items": pa.list_(pa.string()),
        "n_words": pa.int64(),
        "n_hit": pa.int64(),
        "cut_text": pa.string(),
    }

    def of_texts(texts: pa.Array, before: pa.Array) -> pa.Array:
        known: WindowSet = shared.value
        columns = {name: [] for name in kinds}
        for text, old in zip(texts.cast(pa.binary()), before):
            raw, old = text.as_py(), old.as_py() or {"spans": [], "items": []}
            spelled = (raw or b"").translate(_WORD_BYTES)
            found = spelled.split()
            hit, owners = np.zeros(len(found), np.int8), set(old["items"])
            for span in old["spans"]:
                hit[span["start"] : span["stop"]] = 1
            for start, size, names in known.hits(found):
                hit[start : start + size] = 1
                owners.update(names)
            spans = _spans(hit)
            columns["spans"].append(spans)
            columns["items"].append(list(owners))
            columns["n_words"].append(len(found))
            columns["n_hit"].append(int(hit.sum()))
            rest = _cut(raw, spelled, found, spans) if cut and spans else raw
            columns["cut_text"].append(rest.decode() if cut and raw is not None else None)
        arrays = [pa.array(columns[name], kind) for name, kind in kinds.items()]
        return pa.StructArray.from_arrays(arrays, list(kinds))

    return of_texts


def clean_documents(rows: DataFrame, items: DataFrame, text: str = "text", n: int = 10) -> DataFrame:
    """The rows, all columns, of which no window occurs in an item."""
    return scan(rows, items, rows.columns, text, n).where(F.col("n_hit") == 0).select("source.*")


def without_spans(rows: DataFrame, items: DataFrame, text: str = "text", n: int = 10) -> DataFrame:
    """All rows and columns, with the hit words cut out of ``text``."""
    scanned = scan(rows, items, rows.columns, text, n, cut=True)
    kept = [F.col("cut_text").alias(c) if c == text else F.col("source")[c].alias(c) for c in rows.columns]
    return scanned.select(*kept)
