"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from (0, 1) for every key, the key goes to the shard with the best weighted draw.
A draw depends on nothing but the key and the shard, so a new shard only takes keys for itself, and a removed
shard only gives up its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from forumlens.llm.ranks import numbered

# Draws use so many hexadecimal digits of the digest: as many bits as a double holds.
DRAW_DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the text of the key and on the shard; NULL draws as the empty text."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{shard}"))
    whole = F.conv(F.substring(F.md5(text), 1, DRAW_DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / float(16**DRAW_DIGITS)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key: the least ``-ln(draw) / weight``, ties to the lower number.

    A shard gets keys in proportion to its weight. Weights must be positive.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")
    equal = len(set(weights.values())) == 1
    scores = []
    for shard, weight in sorted(weights.items()):
        # The largest draw wins among equal weights; no logarithm is needed to know which.
        score = -draw(key, shard) if equal else -F.ln(draw(key, shard)) / float(weight)
        scores.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def equal_weights(shards: int) -> dict[int, float]:
    return {shard: 1.0 for shard in range(shards)}


def assign(
    rows: DataFrame, key: str, weights: Mapping[int, float], grown: Mapping[int, float], carry: Mapping[str, Column]
) -> DataFrame:
    """Rows as ``key``, the ``carry`` expressions, ``shard``, ``slot`` and ``grown_shard``.

    ``grown_shard`` is the shard under the weights ``grown``. Slots number a shard's rows from 0 without gaps.
    Repeated rows each get a slot of their own, a NULL key is a key like any other, an empty table gives no
    rows. Other columns of ``rows`` are not carried, so their names cannot clash.
    """
    record = F.col(key)
    narrow = rows.select(
        record,
        *[value.alias(name) for name, value in carry.items()],
        shard_of(record, weights).alias("shard"),
        shard_of(record, grown).alias("grown_shard"),
    )
    return numbered(narrow, "shard", [key, *carry], "slot")
