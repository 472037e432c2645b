import math
import struct

import numpy as np
import pyarrow as pa
from helpers import rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from forumlens.functions import vectors

NAN, INF = float("nan"), float("inf")


def test_each_validation_branch(spark):
    cases = {
        "none": None,
        "length": [1.0, 2.0],
        "nonfinite": [1.0, NAN, 2.0],
        "infinite": [1.0, -INF, 2.0],
        "both": [1000.0, NAN, 1.0],
        "extreme": [1.0, -100.5, 2.0],
        "valid": [1.0, -100.0, 2.0],
    }
    frame = spark.createDataFrame(list(cases.items()), "name string, v array<float>")
    found = dict(rows_of(frame.select("name", vectors.validation_reason(F.col("v"), 3).alias("r")), "name", "r"))
    assert found == {
        "none": "none",
        "length": "length",
        "nonfinite": "nonfinite",
        "infinite": "nonfinite",
        "both": "nonfinite",
        "extreme": "extreme",
        "valid": "valid",
    }


def test_blob_validation(spark):
    good = struct.pack("<3f", 1, 2, 3)
    rows = [(1, good), (2, good + b"x"), (3, None), (4, good[:8]), (5, struct.pack("<3f", 1, NAN, 3)), (6, b"")]
    frame = spark.createDataFrame(rows, "id bigint, b binary")
    found = dict(rows_of(frame.select("id", vectors.blob_validation_reason(F.col("b"), 3).alias("r")), "id", "r"))
    assert found == {1: "valid", 2: "buffer", 3: "none", 4: "length", 5: "nonfinite", 6: "length"}


def test_stored_length(spark):
    frame = spark.createDataFrame([(1, 3), (2, 4), (3, None)], "id bigint, n int")
    found = rows_of(frame.where(vectors.has_stored_length_issue(F.col("n"), 3)), "id")
    assert found == [(2,), (3,)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.floats(width=32), max_size=9)), min_size=1, max_size=40))
def test_codec_roundtrip(spark, values):
    frame = spark.createDataFrame(list(enumerate(values)), "id bigint, v array<float>").repartition(2)
    back = frame.select("id", vectors.decode_blob(vectors.encode_blob("v")).alias("v"))
    found = {row["id"]: row["v"] for row in back.collect()}
    for number, value in enumerate(values):
        assert (found[number] is None) == (value is None)
        if value is not None:
            assert np.array_equal(np.float32(found[number]), np.float32(value), equal_nan=True)


def test_codec_equals_bytes_packed_by_hand(spark):
    lists = [[1.5, -2.0], None, [], [0.1], [NAN, INF, -INF, 3e38]] * 3
    frame = spark.createDataFrame(list(enumerate(lists)), "id bigint, v array<float>").coalesce(1)
    found = dict(rows_of(frame.select("id", vectors.encode_blob("v").alias("b")), "id", "b"))
    assert found == {i: None if v is None else struct.pack(f"<{len(v)}f", *v) for i, v in enumerate(lists)}

    blobs = [struct.pack("<2f", 1, 2), b"abc", None, b"", struct.pack("<f", 7) + b"x", struct.pack("<f", 7)] * 3
    frame = spark.createDataFrame(list(enumerate(blobs)), "id bigint, b binary").coalesce(1)
    found = dict(rows_of(frame.select("id", vectors.decode_blob("b").alias("v")), "id", "v"))
    assert found == dict(enumerate([(1.0, 2.0), None, None, (), None, (7.0,)] * 3))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=13)), max_size=12), st.data())
def test_decoding_any_slice_of_a_batch(blobs, data):
    start = data.draw(st.integers(0, len(blobs)))
    stop = data.draw(st.integers(start, len(blobs)))
    for kind in (pa.binary(), pa.large_binary()):
        found = vectors.decode_blob.func(pa.array(blobs, kind).slice(start, stop - start))
        found.validate(full=True)
        for blob, vector in zip(blobs[start:stop], found.to_pylist(), strict=True):
            if blob is None or len(blob) % 4:
                assert vector is None
            else:
                assert struct.pack(f"<{len(vector)}f", *vector) == blob or any(map(math.isnan, vector))
        again = vectors.encode_blob.func(found)
        again.validate(full=True)
        assert vectors.decode_blob.func(again).is_valid().equals(found.is_valid())


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(7)
    pairs = [(i, rng.normal(size=8).astype(np.float32), rng.normal(size=8).astype(np.float32)) for i in range(50)]
    frame = spark.createDataFrame(
        [(i, a.tolist(), b.tolist()) for i, a, b in pairs], "id bigint, a array<float>, b array<float>"
    )
    a, b = F.col("a"), F.col("b")
    found = frame.select(
        "id", vectors.dot(a, b), vectors.norm(a), vectors.cosine(a, b), vectors.squared_l2(a, b),
        vectors.squared_l2(b, a), vectors.max_abs(a),
    ).collect()
    for row in found:
        _, x, y = pairs[row[0]]
        x, y = x.astype(float), y.astype(float)
        expected = [x @ y, np.linalg.norm(x), x @ y / np.linalg.norm(x) / np.linalg.norm(y), ((x - y) ** 2).sum()]
        assert np.allclose(row[1:5], expected)
        assert row[4] == row[5] >= 0
        assert -1 - 1e-12 <= row[3] <= 1 + 1e-12
        assert math.isclose(row[6], np.abs(x).max())


def test_cosine_of_zero_vector_is_null(spark):
    frame = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert frame.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_null_element_is_not_finite(spark):
    rows = spark.createDataFrame([([1.0, None],), ([None, None],), ([1.0, 2.0],)], "v array<double>")
    found = [r[0] for r in rows.select(vectors.validation_reason(F.col("v"), 2)).collect()]
    assert found == ["nonfinite", "nonfinite", "valid"]
