"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Every block is main text or not. A block's score sums the weights of its features (ancestor tags, names of ancestors,
form of the text); a pair of neighbours adds a weight that depends on their labels and on whether one element holds
both. Training maximises the likelihood of labelled pages; pages are decoded with the Viterbi algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from forumlens.llm.blocks import Block, leaf_blocks
from forumlens.llm.labelled_pages import labelled_page

# Labelled pages, steps of training, and the penalty on weights.
TRAINING_PAGES = 1000
STEPS = 120
PENALTY = 0.02


@dataclass
class Field:
    """Weights: of features in favour of main text, and of neighbours by (same element, left label, right label)."""

    features: dict[str, float]
    pairs: np.ndarray

    def score(self, block: Block) -> float:
        weight = self.features.get
        return self._scope_score(block.scope) + sum(weight(name, 0.0) for name in block.features)

    def _scope_score(self, scope) -> float:
        open_scopes = []
        while scope is not None and scope.score is None:  # blocks of one element share it
            open_scopes.append(scope)
            scope = scope.parent
        score = scope.score if scope is not None else 0.0
        for scope in reversed(open_scopes):
            score = scope.score = score + sum(self.features.get(name, 0.0) for name in scope.features)
        return score

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels of a page; of equally likely ones those that keep more text."""
        pairs = self.pairs.tolist()
        off, on = 0.0, 0.0
        back: list[tuple[int, int]] = []
        for place, block in enumerate(blocks):
            score = self.score(block)
            if place == 0:
                off, on = 0.0, score
                continue
            step = pairs[block.container == blocks[place - 1].container]
            to_off, to_on = (off + step[0][0], on + step[1][0]), (off + step[0][1], on + step[1][1])
            back.append((int(to_off[1] >= to_off[0]), int(to_on[1] >= to_on[0])))
            off, on = max(to_off), max(to_on) + score
        label = int(on >= off)
        labels = [label] if blocks else []
        for previous in reversed(back):
            label = previous[label]
            labels.append(label)
        return [bool(label) for label in reversed(labels)]


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html or "")
    return "\n".join(block.text for block, kept in zip(blocks, field.decode(blocks)) if kept)


def fit(pages: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """A field trained on pages whose main blocks are marked. No pages give a field that keeps every block."""
    parsed = [blocks for blocks in map(leaf_blocks, pages) if blocks]
    numbers: dict[str, int] = {}
    longest = max((len(blocks) for blocks in parsed), default=0)
    shape = (len(parsed), longest)
    labels, inside = np.zeros(shape, int), np.zeros(shape, bool)
    same = np.zeros(shape, int)
    cells, columns = [], []
    for row, blocks in enumerate(parsed):
        for place, block in enumerate(blocks):
            labels[row, place], inside[row, place] = block.marked, True
            same[row, place] = place > 0 and block.container == blocks[place - 1].container
            names = [*block.features, *(name for scope in block.scope.chain() for name in scope.features)]
            cells.extend([row * longest + place] * len(names))
            columns.extend(numbers.setdefault(name, len(numbers)) for name in names)
    cells, columns = np.array(cells, int), np.array(columns, int)
    weights, pairs = np.zeros(len(numbers)), np.zeros((2, 2, 2))
    observed = np.bincount(columns, labels.ravel()[cells], len(numbers))
    joined = inside[:, 1:]
    observed_pairs = np.zeros((2, 2, 2))
    np.add.at(observed_pairs, (same[:, 1:][joined], labels[:, :-1][joined], labels[:, 1:][joined]), 1)
    sums, pair_sums = np.full(len(numbers), 1e-6), np.full((2, 2, 2), 1e-6)
    for _ in range(steps if parsed else 0):
        scores = np.bincount(cells, weights[columns], longest * len(parsed)).reshape(shape)
        on, expected_pairs = _marginals(scores, pairs, same, inside)
        gradient = observed - np.bincount(columns, on.ravel()[cells], len(numbers)) - penalty * weights
        pair_gradient = observed_pairs - expected_pairs - penalty * pairs
        sums += gradient**2
        pair_sums += pair_gradient**2
        weights += 0.3 * gradient / np.sqrt(sums)
        pairs += 0.3 * pair_gradient / np.sqrt(pair_sums)
    return Field({name: float(weights[number]) for name, number in numbers.items()}, pairs)


def _marginals(scores: np.ndarray, pairs: np.ndarray, same: np.ndarray, inside: np.ndarray):
    """Probability of label 1 for every block and expected counts of neighbours, for all pages at once."""
    pages, longest = scores.shape
    forward, backward = np.zeros((longest, pages, 2)), np.zeros((longest, pages, 2))
    emitted = np.stack([np.zeros_like(scores), scores], axis=2)
    forward[0] = emitted[:, 0]
    for place in range(1, longest):
        step = np.logaddexp.reduce(forward[place - 1][:, :, None] + pairs[same[:, place]], axis=1) + emitted[:, place]
        forward[place] = np.where(inside[:, place, None], step, forward[place - 1])
    for place in range(longest - 2, -1, -1):
        after = emitted[:, place + 1] + backward[place + 1]
        step = np.logaddexp.reduce(pairs[same[:, place + 1]] + after[:, None, :], axis=2)
        backward[place] = np.where(inside[:, place + 1, None], step, 0.0)
    whole = np.logaddexp.reduce(forward[-1], axis=1)
    on = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole).T * inside
    expected = np.zeros((2, 2, 2))
    for place in range(1, longest):
        after = emitted[:, place] + backward[place]
        joint = forward[place - 1][:, :, None] + pairs[same[:, place]] + after[:, None, :] - whole[:, None, None]
        rows = inside[:, place]
        np.add.at(expected, same[rows, place], np.exp(joint[rows]))
    return on, expected


def labelled_pages(spark: SparkSession, pages: int = TRAINING_PAGES) -> DataFrame:
    """``html`` of pages whose main blocks are marked; every page is drawn from its number alone."""
    made = spark.range(pages).repartition(4)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(labelled_page, batch.column(0).to_pylist()), pa.string())], ["html"])

    return made.mapInArrow(draw, "html string")


def train(labelled: DataFrame, limit: int = TRAINING_PAGES) -> Field:
    """A field trained on the marked pages of ``labelled`` (``html``), of which at most ``limit`` reach the driver."""
    pages = labelled.where(F.col("html").isNotNull()).limit(limit).toArrow().column("html").to_pylist()
    return fit(sorted(pages))


def extract(pages: DataFrame, field: Field, carry: list[str], html: str = "html") -> DataFrame:
    """Every row as ``source`` (a struct of the ``carry`` columns) and ``text``.

    The text joins the blocks that the field keeps by one line feed; it is empty where there are none, as on NULL and
    empty pages. Repeated rows are extracted alike; columns that are not carried are left out.
    """
    chosen = pages.select(F.struct(*carry).alias("source"), F.col(html).alias("page"))
    shared = pages.sparkSession.sparkContext.broadcast(field)
    schema = T.StructType([chosen.schema["source"], T.StructField("text", T.StringType())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), shared.value) for page in batch.column("page")]
            yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(texts, pa.string())], ["source", "text"])

    return chosen.mapInArrow(of_batches, schema)
