"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1. The vector of an n-gram binds its letters by multiplying their vectors,
each rotated by its place; a text is the sum of its n-grams, a language the sum of its training texts. A text gets the
language whose profile has the largest cosine with it. Vectors are kept as bits where that is exact: multiplication
of signs is XOR of bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from forumlens.sources.snapshots import materialize

UNKNOWN = "und"
DIMENSIONS = 1024
GRAM = 3
# Training texts of a language: all, or a sample by the hash of the key of about so many.
TRAINING_DOCUMENTS = 5000
# Cosines of a text without a known n-gram have a standard deviation of DIMENSIONS ** -0.5; four of them are chance.
CHANCE = 4 * DIMENSIONS**-0.5
# Fewer letters than this have too few n-grams for a low cosine to mean anything.
TELLING_LETTERS = 20
# This share of the labelled texts may fall below the least score.
UNUSUAL = 0.001
_SAMPLE_STEPS = 1 << 30
_SYMBOLS_AT_ONCE = 1 << 18
# Texts whose vectors a task holds at once, and n-grams whose vectors it draws at once: some 4 to 8 MB each.
_TEXTS_AT_ONCE, _GRAMS_AT_ONCE = 512, 1024
_SPACE = 32
_BITS = 21  # of a code point


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


class _Encoder:
    """Vectors of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram, self.letters = dimensions, gram, _letter_table()

    def symbols(self, text: str) -> np.ndarray:
        """Letters in lower case, one space for anything between, before and after them; empty without letters."""
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
        known = self.letters[codes]
        if not known.any():
            return codes[:0]
        kept = known.copy()
        kept[0] = True
        kept[1:] |= known[:-1]  # the first of every run of others
        return np.where(known, codes, _SPACE)[kept].astype(np.int64)

    def letter_bits(self, codes: np.ndarray) -> np.ndarray:
        """The random bits of letters, drawn from nothing but the code point."""
        lanes = np.arange(self.dimensions // 64, dtype=np.uint64)
        x = (codes.astype(np.uint64)[:, None] << np.uint64(16)) + lanes + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(32)
        return np.unpackbits(x.astype(">u8").view(np.uint8), axis=1)

    def gram_signs(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of packed n-grams, as rows of -1 and 1."""
        mask = (1 << _BITS) - 1
        bound = np.zeros((len(grams), self.dimensions), np.uint8)
        for place in range(self.gram):
            codes, at = np.unique((grams >> (_BITS * place)) & mask, return_inverse=True)
            bound ^= np.roll(self.letter_bits(codes), place, axis=1)[at]
        return 1.0 - 2.0 * bound.astype(np.float32)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; zero where there is no letter or no text."""
        total = np.zeros((len(texts), self.dimensions))
        rows, parts, waiting = [], [], 0
        for row, text in enumerate(texts):
            symbols = self.symbols(text) if text else ()
            # Long texts go in slices that overlap, so that every n-gram is in exactly one of them.
            for at in range(0, max(0, len(symbols) - self.gram + 1), _SYMBOLS_AT_ONCE):
                part = symbols[at : at + _SYMBOLS_AT_ONCE + self.gram - 1]
                rows.append(row)
                parts.append(part)
                waiting += len(part)
                if waiting >= _SYMBOLS_AT_ONCE:
                    self._bundle(total, rows, parts)
                    rows, parts, waiting = [], [], 0
        if parts:
            self._bundle(total, rows, parts)
        return total

    def _bundle(self, total: np.ndarray, rows: list[int], parts: list[np.ndarray]) -> None:
        packed, owners = [], []
        for number, part in enumerate(parts):
            count = len(part) - self.gram + 1
            value = np.zeros(count, np.int64)
            for place in range(self.gram):
                value |= part[place : place + count] << (_BITS * (self.gram - 1 - place))
            packed.append(value)
            owners.append(np.full(count, number))
        grams, at = np.unique(np.concatenate(packed), return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], np.concatenate(owners)[order]
        sums = np.zeros((len(parts), self.dimensions), np.float32)
        for start in range(0, len(grams), _GRAMS_AT_ONCE):
            some = grams[start : start + _GRAMS_AT_ONCE]
            a, b = np.searchsorted(at, [start, start + len(some)])
            counts = np.bincount(owner[a:b] * len(some) + at[a:b] - start, minlength=len(parts) * len(some))
            sums += counts.reshape(len(parts), len(some)).astype(np.float32) @ self.gram_signs(some)
        np.add.at(total, rows, sums)


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches so small that a task never holds the vectors of many texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
            yield batch.slice(at, _TEXTS_AT_ONCE)


@dataclass(frozen=True)
class Profiles:
    """Languages in alphabetical order and their vectors of length one."""

    languages: list[str]
    vectors: np.ndarray


def _sampled(rows: DataFrame, key: str, language: str, documents: int) -> DataFrame:
    counts = rows.groupBy(language).agg(F.count("*").alias("rows")).collect()
    share = F.lit(0)
    for row in counts:
        limit = min(_SAMPLE_STEPS, int(documents / row["rows"] * _SAMPLE_STEPS))
        share = F.when(F.col(language) == row[language], limit).otherwise(share)
    # A NULL key hashes like any other value.
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("training")), F.lit(_SAMPLE_STEPS)) < share)


def train(
    rows: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", documents: int = TRAINING_DOCUMENTS
) -> Profiles:
    """Profiles of the languages of ``rows``, from about ``documents`` texts of each at most.

    Rows without a language are left out; texts without letters add nothing. Sums run in the tasks; one vector per
    language reaches the driver. Languages without any letter and empty tables give no profile.
    """
    labelled = rows.select(key, text, language).where(F.col(language).isNotNull())
    chosen = _sampled(labelled, key, language, documents).select(F.col(text).alias("t"), F.col(language).alias("l"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = _Encoder(), {}
        for batch in _in_slices(batches):
            languages = np.array(batch.column("l").to_pylist(), object)
            vectors = encoder.vectors(batch.column("t").to_pylist())
            for name in set(languages):
                total[name] = total.get(name, 0) + vectors[languages == name].sum(axis=0)
        vectors = pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), vectors], names=["l", "vector"])

    parts = chosen.mapInArrow(sums, "l string, vector array<double>")
    places = parts.select("l", F.posexplode("vector").alias("place", "value"))
    whole = places.groupBy("l", "place").agg(F.sum("value").alias("value"))
    found = whole.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("parts")).collect()
    known = {row["l"]: np.array([part["value"] for part in row["parts"]]) for row in found}
    known = {name: vector / np.linalg.norm(vector) for name, vector in sorted(known.items()) if vector.any()}
    return Profiles(list(known), np.array(list(known.values())).reshape(len(known), DIMENSIONS))


def predict(rows: DataFrame, profiles: Profiles, carry: list[str], text: str = "text") -> DataFrame:
    """Every row as ``source`` (a struct of the ``carry`` columns), ``lang_pred, score``.

    ``score`` is the cosine with the best profile, at least 0; equal cosines go to the first language by name. NULL
    texts, texts without a letter, and all texts if there is no profile are ``und`` with score 0. Columns that are not
    carried are left out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(profiles)

    def of_texts(texts: pa.Array) -> pa.Array:
        encoder, known = _Encoder(), shared.value
        names = np.array([*known.languages, UNKNOWN], object)
        found, scores = [pa.array([], pa.string())], [pa.array([], pa.float64())]
        for at in range(0, len(texts), _TEXTS_AT_ONCE):
            vectors = encoder.vectors(texts.slice(at, _TEXTS_AT_ONCE).to_pylist())
            sizes = np.linalg.norm(vectors, axis=1)
            best, score = np.full(len(vectors), len(names) - 1), np.zeros(len(vectors))
            if known.languages:
                cosines = vectors @ known.vectors.T / np.where(sizes > 0, sizes, 1.0)[:, None]
                best = np.where(sizes > 0, cosines.argmax(axis=1), best)
                score = np.where(sizes > 0, np.clip(cosines.max(axis=1), 0.0, 1.0), 0.0)
            found.append(pa.array(names[best], pa.string()))
            scores.append(pa.array(score))
        return pa.StructArray.from_arrays([pa.concat_arrays(found), pa.concat_arrays(scores)], ["lang_pred", "score"])

    # Of a row, only its text goes to Python, once, and none comes back. Marked nondeterministic, so that no filter on what
    # is found repeats the call.
    predicted = F.arrow_udf(of_texts, "struct<lang_pred:string,score:double>").asNondeterministic()
    found = rows.select(F.struct(*carry).alias("source"), predicted(F.col(text)).alias("predicted"))
    return found.select("source", "predicted.lang_pred", "predicted.score")


def held_out(key: Column) -> Column:
    """Whether a record is kept from training: CRC-32 of the key's text modulo 4 is 2. A NULL key is the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def rejected(language: Column) -> Column:
    """Whether a filter on language drops a text: it has no letters to tell its language by."""
    return language == UNKNOWN


def least_score(rows: DataFrame, profiles: Profiles, text: str = "text", language: str = "lang") -> float:
    """The score below which a text is in none of the languages: what chance gives, or less if labelled texts of enough
    letters whose language is found score less.

    All labelled texts count, and the share of them that may score less is counted exactly. Their scores alone are written;
    only those below chance are ordered.
    """
    labelled = rows.select(text, language).where(F.col(language).isNotNull() & _telling(F.col(text)))
    found = predict(labelled, profiles, [language], text)
    usual = materialize(found.where(F.col("lang_pred") == F.col("source")[language]).select("score"))
    low = usual.where(F.col("score") < CHANCE)
    place = max(1, math.ceil(UNUSUAL * usual.count()))
    if low.count() < place:
        return CHANCE
    return low.orderBy("score").offset(place - 1).first()[0]


def _telling(text: Column) -> Column:
    """Whether a text has enough letters; no more of it is looked at than that takes."""
    return text.rlike(r"\A(?:\P{L}*+\p{L}){%d}" % TELLING_LETTERS)


def unlike_all(text: Column, score: Column, least: float) -> Column:
    """Whether a filter on language drops a text: it has enough letters, and no profile is like it."""
    return (score < least) & _telling(text)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
