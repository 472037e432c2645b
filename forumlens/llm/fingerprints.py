"""Document fingerprints by consistent weighted sampling.

A document is a multiset of five-word shingles. For every sample and shingle, two gamma variates and a uniform one that
depend on nothing but the shingle and the sample turn the shingle's count into a rank; the sample is the shingle, and the
step of its count, of the least rank. Two documents have equal samples with the probability of their generalised Jaccard
similarity, the sum of the smaller counts over the sum of the larger ones. Everything is expressions and joins; no Python
runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from forumlens.sources.snapshots import materialize

SAMPLES = 32
WORDS = 5
# Hexadecimal digits of a sample in a fingerprint.
DIGITS = 8

# A sample's least rank is beyond the bound that excludes terms with a probability of exp(-40), some 4e-18.
CERTAIN = 40.0

# Uniform variates take so many bits of a hash, three from each; ranks are compared at so many steps per unit.
_BITS = 21
_STEPS = 1 << 25


def words_of(text: Column) -> Column:
    """Words of a text: runs without white space, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def terms(found: str, words: int = WORDS) -> Column:
    """Hashes of all shingles of a column of words, repeats included.

    Fewer words than a shingle has make one shingle, no words make none. The words must be a column, not an expression,
    which would be evaluated for every shingle.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(found) - (words - 1), F.lit(1)))
    hashes = F.transform(starts, lambda start: F.xxhash64(F.slice(F.col(found), start, words)))
    return F.when(F.size(found) > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _uniform(bits: Column, place: int) -> Column:
    """A number in (0, 1) from the bits of a hash."""
    part = F.shiftrightunsigned(bits, place * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))
    return (part.cast("double") + 0.5) * 2.0**-_BITS


def sample(number: int, term: Column, count: Column, log_count: Column, total: Column) -> Column:
    """Rank and identity of a term in one sample as a number: the rank above, the identity in the lower 32 bits.

    ``r`` and ``c`` are gamma variates of shape 2, sums of two exponential ones, and ``b`` is uniform. The count is taken
    at the step ``t`` at or below it, and the rank is the logarithm of ``c / exp(r (t - b + 1))``. NULL where the term
    cannot have the least rank: the least of all is exponential with the rate ``total``, the sum of the counts, so it is
    above ``CERTAIN / total`` with a probability of ``exp(-CERTAIN)``, and a bound without logarithms shows for most terms
    that they are.
    """
    first = F.xxhash64(term, F.lit(2 * number))
    second = F.xxhash64(term, F.lit(2 * number + 1))
    small_r, small_c, b = _uniform(first, 0) * _uniform(first, 1), _uniform(second, 0) * _uniform(second, 1), _uniform(first, 2)
    # -ln(x) is at least 1 - x; a weighted geometric mean is at least the harmonic one.
    shrink = F.when(count == 1, small_r / ((1 - b) + b * small_r)).otherwise(small_r / count)
    r, c = -F.ln(small_r), -F.ln(small_c)
    step = F.floor(log_count / r + b)
    rank = F.ln(c) - r * (step - b + 1)
    identity = F.xxhash64(first, step).bitwiseAND(F.lit(0xFFFFFFFF))
    packed = F.shiftleft(F.floor(rank * _STEPS).cast("long"), 32).bitwiseOR(identity)
    return F.when((1 - small_c) * shrink * total <= CERTAIN, packed)


def neighbours(rows: DataFrame) -> DataFrame:
    """``key, next_key, before, before_chars`` of every distinct ``key`` of ``rows`` (``key``, ``chars``), in ascending
    order and round from the last to the first: the key after it, the key before it and the most characters there.

    Only keys move: ranges of them are written, linked inside a range, and the few range ends linked to each other.
    """
    keys = rows.groupBy("key").agg(F.max("chars").alias("chars")).repartitionByRange("key")
    kept = materialize(keys.withColumn("cell", F.spark_partition_id()))
    ends = kept.groupBy("cell").agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.max_by("chars", "key").alias("last_chars")
    )
    # One row per range; the constant group is as large as the number of ranges.
    cells = Window.partitionBy(F.lit(0)).orderBy("cell")
    whole = cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "cell",
        F.coalesce(F.lead("first_key").over(cells), F.first("first_key").over(whole)).alias("after_cell"),
        F.coalesce(F.lag("last_key").over(cells), F.last("last_key").over(whole)).alias("before_cell"),
        F.coalesce(F.lag("last_chars").over(cells), F.last("last_chars").over(whole)).alias("before_cell_chars"),
    )
    inside = Window.partitionBy("cell").orderBy("key")
    linked = kept.select(
        "cell", "key", F.lead("key").over(inside).alias("n"), F.lag("key").over(inside).alias("b"),
        F.lag("chars").over(inside).alias("c"),
    )
    return linked.join(ends, "cell").select(
        "key",
        F.coalesce("n", "after_cell").alias("next_key"),
        F.coalesce("b", "before_cell").alias("before"),
        F.coalesce("c", "before_cell_chars").alias("before_chars"),
    )


def counted(hashes: str, starts: str) -> Column:
    """Distinct hashes and their counts, from a sorted array and the places where its runs start."""
    runs = F.sequence(F.lit(0), F.size(starts) - 1)
    start = F.col(starts)
    ends = F.coalesce(F.size(hashes), F.lit(0))
    each = F.transform(
        runs,
        lambda i: F.struct(
            F.get(F.col(hashes), F.get(start, i)).alias("term"),
            (F.coalesce(F.get(start, i + 1), ends) - F.get(start, i)).cast("double").alias("count"),
        ),
    )
    return each


def fingerprints(rows: DataFrame, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """``id, side, n_chars, sha256, signature`` for every row and side of ``rows`` (``id`` long, ``key``, ``sides``).

    ``sides`` is an array of texts. ``rows`` must be partitioned by ``key``; then nothing moves: shingles are counted in the
    row of their text and sampled in its task, which holds one signature per text and never the shingles of all its texts. The
    signature joins the samples as hexadecimal digits, zeros without shingles.
    """
    each = rows.select("key", "id", F.posexplode_outer("sides").alias("side", "own"))
    sha = F.sha2(F.col("own").cast("binary"), 256)
    each = each.select("key", "id", "side", F.length("own").alias("n_chars"), sha.alias("sha256"), words_of(F.col("own")).alias("words"))
    own = ["key", "id", "side", "n_chars", "sha256"]
    # Arrays are columns before lambdas use them, since an expression would be evaluated again for every element.
    each = each.select(*own, terms("words", words).alias("hashes"))
    own.append("total")
    each = each.select("*", F.size("hashes").cast("double").alias("total"), F.array_distinct("hashes").alias("different"))
    repeats = F.size("different") < F.size("hashes")
    each = each.select(*own, "different", F.when(repeats, F.sort_array("hashes")).alias("hashes"))
    places = F.sequence(F.lit(0), F.size("hashes") - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get(F.col("hashes"), i) != F.get(F.col("hashes"), i - 1)))
    each = each.select(*own, "different", "hashes", F.when(F.col("hashes").isNotNull(), begins).alias("starts"))
    once = F.transform("different", lambda term: F.struct(term.alias("term"), F.lit(1.0).alias("count")))
    pairs = F.when(F.col("starts").isNull(), once).otherwise(counted("hashes", "starts"))
    # An outer generator has no filter inferred below it, which would build the arrays a second time.
    each = each.select(*own, F.inline_outer(pairs)).withColumn("log_count", F.ln("count"))
    figures = F.col("term"), F.col("count"), F.col("log_count"), F.col("total")
    least = [F.min(sample(number, *figures)).alias(f"s{number}") for number in range(samples)]
    found = each.groupBy(*own).agg(*least)
    low = [F.coalesce(F.col(f"s{n}"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)) for n in range(samples)]
    return found.select(*own, F.concat(*[F.lpad(F.lower(F.hex(part)), DIGITS, "0") for part in low]).alias("signature"))


def likeness(left: Column, right: Column) -> Column:
    """The share of equal samples of two signatures; NULL if one is missing."""
    samples = (F.length(left) / DIGITS).cast("int")
    starts = F.sequence(F.lit(0), samples - 1)
    equal = F.filter(
        starts, lambda i: F.substr(left, i * DIGITS + 1, F.lit(DIGITS)) == F.substr(right, i * DIGITS + 1, F.lit(DIGITS))
    )
    return F.size(equal) / samples


def edited_fingerprints(rows: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Every row as ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text of a row has the last ``floor(n_chars / 2)`` code points replaced by as many, or all, first ones of the
    next document: the next larger key, the smallest after the largest. ``key`` is a whole number. NULL texts count as
    empty, which have no shingles and a fingerprint of zeros. Rows that repeat a key each have a fingerprint of their own;
    as next document the first of their texts in byte order counts, and ``near_next`` compares with the first fingerprint
    in order. A NULL key is below all others. Other columns are not carried; no rows give no rows.
    """
    lowest = -(2**63)
    texts = rows.select(
        F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("own")
    )
    links = materialize(neighbours(texts.select("key", F.length("own").alias("chars"))))
    linked = texts.join(links, "key")
    # Of a text, only the start that can be needed moves to the document before it.
    starts = linked.select(
        F.col("before").alias("key"), F.left("own", F.floor(F.col("before_chars") / 2).cast("int")).alias("start")
    )
    starts = starts.groupBy("key").agg(F.min("start").alias("start"))
    half = F.floor(F.length("own") / 2).cast("int")
    edited = F.concat(F.left("own", F.length("own") - half), F.left("start", half))
    joined = linked.select("key", "own").join(starts, "key")
    sides = joined.select("key", F.monotonically_increasing_id().alias("id"), F.array("own", edited).alias("sides"))
    found = fingerprints(sides, samples)

    def on(side: int, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    whole = materialize(
        found.groupBy("key", "id").agg(
            on(0, "n_chars").alias("n_chars"),
            on(1, "sha256").alias("edited_sha256"),
            on(0, "signature").alias("fingerprint"),
            on(1, "signature").alias("edited_fingerprint"),
        )
    )
    next_prints = whole.groupBy("key").agg(F.min("fingerprint").alias("next_fingerprint"))
    next_prints = next_prints.join(links.select("key", "before"), "key").select(F.col("before").alias("key"), "next_fingerprint")
    return whole.join(next_prints, "key").select(
        F.when(F.col("key") != lowest, F.col("key")).alias(key),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
