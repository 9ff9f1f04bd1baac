"""Packed vectors and their arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_vec(blobs: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to an array; null stays null."""
    sizes = pc.fill_null(pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False) // 4
    values = np.frombuffer(b"".join(blobs.drop_null().to_pylist()), "<f4")
    return pa.ListArray.from_arrays(pa.array(_offsets(sizes)), pa.array(values, pa.float32()), mask=blobs.is_null())


@F.arrow_udf(T.BinaryType())
def encode_vec(arrays: pa.Array) -> pa.Array:
    """The other way round."""
    sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
    values = arrays.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    offsets = _offsets(sizes * 4)
    packed = pa.Array.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])
    return pc.if_else(arrays.is_null(), pa.scalar(None, pa.binary()), packed)


def vector_fault(vector: Column, dim: int) -> Column:
    """Why a vector is not valid, or null.  A missing vector is valid."""
    size = F.size(vector)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (size != dim), F.concat(
        F.lit(f"Dimension mismatch: expected {dim}, got "), size.cast("string"))
    ).when(vector.isNotNull() & bad, F.lit("Vector contains non-finite values"))
