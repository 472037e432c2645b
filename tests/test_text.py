import hashlib

import numpy as np
from helpers import rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from forumlens.functions import scoring, text
from forumlens.operators import embedding

TEXTS = st.lists(st.text(alphabet="ab 1é.\n\t!-ß ", max_size=30), min_size=1, max_size=60)


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_truncation_is_a_prefix(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    over = text.is_over_limit(F.col("t"), 4)
    cut = frame.select("t", over.alias("over"), text.token_count(F.col("t")).alias("n")).withColumn(
        "kept", text.truncate_tokens(F.col("t"), F.col("over"), 4)
    )
    again = cut.withColumn("kept_n", text.token_count(F.col("kept")))
    for row in again.collect():
        assert row["t"].startswith(row["kept"])
        assert row["over"] == (row["n"] > 4)
        assert row["kept_n"] == min(row["n"], 4)
        assert row["over"] or row["kept"] == row["t"]


def test_default_limit_is_reached_by_long_texts(spark):
    frame = spark.createDataFrame([(1, "w " * 8191), (2, "w " * 8192)], "id bigint, t string")
    flagged = frame.select("id", text.is_over_limit(F.col("t")).alias("over"), "t")
    cut = flagged.select("id", "over", text.token_count(text.truncate_tokens(F.col("t"), F.col("over"))).alias("n"))
    assert rows_of(cut, "id", "over", "n") == [(1, False, 8191), (2, True, 8191)]


def test_rendering_helpers(spark):
    frame = spark.createDataFrame([("a & b <i>\"x\"</i> 'y' &amp;", 1704067200)], "t string, s bigint")
    row = frame.select(
        text.html_escape(F.col("t")), text.epoch_text(F.col("s")), text.four_decimals(F.lit(0.123456))
    ).first()
    assert tuple(row) == (
        "a &amp; b &lt;i&gt;&quot;x&quot;&lt;/i&gt; &#039;y&#039; &amp;amp;",
        "2024-01-01 00:00:00",
        "0.1235",
    )


def test_epoch_text_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = spark.range(1).select(text.epoch_text(F.lit(1710054000))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == "2024-03-10 07:00:00"


def test_recency(spark):
    frame = spark.createDataFrame([(1000,), (1000 - 864000,), (1000 + 864000,), (None,)], "d bigint")
    found = [r[0] for r in frame.select(scoring.recency(F.col("d"), F.lit(1000))).collect()]
    assert found == [1.0, 0.5, 0.5, 1.0]


def expected_vector(message, dim):
    import regex

    counts = np.zeros(dim)
    for word in regex.findall(r"[\p{L}\p{N}]+", message.lower()):
        digest = hashlib.md5(word.encode()).hexdigest()
        counts[int(digest[:8], 16) % dim] += 1 if int(digest[8], 16) % 2 == 0 else -1
    norm = np.sqrt((counts**2).sum())
    return None if norm == 0 else (counts / norm).astype(np.float32)


@settings(max_examples=4, deadline=None)
@given(TEXTS)
def test_hashed_vectors_equal_direct_computation(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts + ["", None])), "id bigint, t string").repartition(3)
    made = embedding.embed_column(frame, "t", embedding.hashed_embedder(16))
    found = {row["id"]: row["embedding"] for row in made.collect()}
    for number, message in enumerate(texts + ["", ""]):
        expected = expected_vector(message, 16)
        if expected is None:
            assert found[number] is None
        else:
            assert np.array_equal(np.float32(found[number]), expected)


def test_model_embedder_batches(spark):
    def load():
        def embed(texts):
            assert 0 < len(texts) <= 7
            return [[float(len(t)), float(len(texts))] for t in texts]

        return embed

    texts = [(i, None if i % 10 == 0 else "x" * i) for i in range(50)]
    frame = spark.createDataFrame(texts, "id bigint, t string").coalesce(1)
    made = embedding.embed_column(frame, "t", embedding.model_embedder(load, batch_rows=7))
    found = {row["id"]: row["embedding"] for row in made.collect()}
    assert all((found[i] is None) == (t is None) for i, t in texts)
    assert all(found[i][0] == len(t) for i, t in texts if t is not None)


def test_blank_queries_are_not_embedded(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, "  "), (3, None)], "query_id bigint, query string")
    assert rows_of(embedding.embed_queries(frame, embedding.hashed_embedder(8)), "query_id") == [(1,)]
