"""Join helpers for keys that are missing or very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows of a side that may be broadcast. Rows of these sides are narrow (ids, one term, a few numbers).
BROADCAST_ROWS = 100_000
# Bytes of their texts, where rows carry words or phrases of any length.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], spread_on: str, broadcast: bool) -> DataFrame:
    """Join a large side whose key may be hot to a small side.

    A checked small side is broadcast and the large side never moves. Otherwise the large side is salted by
    ``spread_on``, a column that differs within a hot key, and the small side repeats once per salt: no task
    holds more than a salt's share of a hot key.
    """
    if broadcast:
        return big.join(F.broadcast(small), keys)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def nullable_key_left_join(left: DataFrame, right: DataFrame, key: str, spread_on: str) -> DataFrame:
    """Left join on a key that many left rows lack.

    Rows without the key would all meet in one partition; they are spread by another column instead, and the
    extra condition keeps a spread value from meeting an equal real key.
    """
    keyed = left.withColumns(
        {"_key": F.coalesce(F.col(key), F.xxhash64(spread_on)), "_has_key": F.col(key).isNotNull()}
    )
    other = right.withColumnRenamed(key, "_right_key")
    matched = keyed.join(other, (F.col("_key") == F.col("_right_key")) & F.col("_has_key"), "left")
    return matched.drop("_key", "_has_key", "_right_key")
