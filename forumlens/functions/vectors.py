"""Vector expressions over ``array<float>`` columns. Sums run in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from forumlens.schemas import EXPECTED_DIM, MAX_ABS_VALUE


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_l2(a: Column, b: Column) -> Column:
    def squared_gap(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _sum(F.zip_with(a, b, squared_gap))


def cosine_from_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity from norms computed once per row; NULL when either vector is zero."""
    return dot(a, b) / F.nullif(norm_a * norm_b, F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    return cosine_from_norms(a, b, norm(a), norm(b))


def max_abs(a: Column) -> Column:
    """Largest absolute element. NaN if any element is NaN, because NaN sorts above every number."""
    return F.array_max(F.transform(a, F.abs))


def all_finite(a: Column) -> Column:
    peak = max_abs(a)
    return ~(F.isnan(peak) | (peak == float("inf")))


def validation_reason(vector: Column, dim: int = EXPECTED_DIM, limit: float = MAX_ABS_VALUE) -> Column:
    """``valid``, or the first check that fails: none, length, nonfinite, extreme.

    The valid branch stands before the two failing ones, so that a good row computes its peak once;
    NaN and infinity both compare greater than the limit and fall through to their own branch. An element that is
    NULL counts as not finite.
    """
    peak = max_abs(vector)
    return (
        F.when(vector.isNull(), "none")
        .when(F.size(vector) != dim, "length")
        .when(F.exists(vector, lambda x: x.isNull()), "nonfinite")
        .when(peak <= limit, "valid")
        .when(peak.isNull() | F.isnan(peak) | (peak == float("inf")), "nonfinite")
        .otherwise("extreme")
    )


def blob_validation_reason(blob: Column, dim: int = EXPECTED_DIM, limit: float = MAX_ABS_VALUE) -> Column:
    """The same checks on a stored blob, with ``buffer`` for a byte count no float32 vector can have."""
    return (
        F.when(blob.isNull(), "none")
        .when(F.length(blob) % 4 != 0, "buffer")
        .otherwise(validation_reason(decode_blob(blob), dim, limit))
    )


def has_stored_length_issue(embedding_length: Column, dim: int = EXPECTED_DIM) -> Column:
    """The recorded length disagrees with the model, whatever the vector itself looks like."""
    return ~embedding_length.eqNullSafe(F.lit(dim))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_blob(blobs: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to a vector; NULL when the bytes cannot be one. The bytes are not copied by row."""
    lengths = pc.binary_length(blobs)
    usable = pc.fill_null(pc.equal(pc.bit_wise_and(lengths, 3), 0), False)
    # The values then lie end to end in one buffer, whatever the nulls held.
    kept = blobs if pc.all(usable).as_py() else pc.if_else(usable, blobs, pa.scalar(b"", blobs.type))
    offset_type = np.int64 if pa.types.is_large_binary(kept.type) else np.int32
    ends = np.frombuffer(kept.buffers()[1] or bytes(8), offset_type)[kept.offset : kept.offset + len(kept) + 1]
    start, size = int(ends[0]), int(ends[-1] - ends[0])
    floats = np.frombuffer(kept.buffers()[2], "<f4", count=size // 4, offset=start) if size else np.zeros(0, "<f4")
    floats = np.require(floats, requirements="A")
    offsets = pa.array(((ends - ends[0]) // 4).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(floats), mask=pc.invert(usable))


@F.arrow_udf(T.BinaryType())
def encode_blob(vectors: pa.Array) -> pa.Array:
    """A vector to little-endian float32 bytes. The floats of a batch become the bytes of its rows as they lie."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    ends = np.zeros(len(vectors) + 1, dtype=np.int64)
    np.cumsum(sizes * 4, out=ends[1:])
    payload = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4", copy=False)
    known = np.packbits(vectors.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
    parts = [pa.py_buffer(known), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(payload))]
    return pa.Array.from_buffers(pa.large_binary(), len(vectors), parts).cast(pa.binary())
