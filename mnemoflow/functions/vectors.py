"""Embeddings: normalising, int8 quantisation, base64, cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

ENCODING = "int8:maxabs:v1"


def finite_values(vector: Column) -> Column:
    """The finite numbers of a vector, in order; null gives an empty vector."""
    doubles = F.transform(F.coalesce(vector, F.array()), lambda x: x.try_cast("double"))
    return F.filter(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _zeroed(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x.cast("double")))


def quantize(vector: Column) -> Column:
    """struct(q array<tinyint>, scale, dims) of a vector; null where it is null, empty or all zero. Halves round up."""
    clean = _zeroed(vector)
    most = F.array_max(F.transform(clean, F.abs))
    q = F.transform(clean, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / most * 127 + 0.5))).cast("tinyint"))
    return F.when(most > 0, F.struct(q.alias("q"), (most / 127).alias("scale"), F.size(vector).alias("dims")))


@arrow_udf(T.BinaryType())
def _bytes(q: pa.Array) -> pa.Array:
    """The int8 values of each row as they lie in memory."""
    flat = np.ascontiguousarray(q.flatten().fill_null(0).to_numpy(zero_copy_only=False), np.int8)
    ends = np.concatenate(([0], np.cumsum(q.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int32)
    mask = pa.py_buffer(np.packbits(np.asarray(q.is_valid()), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(q), [mask, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


def to_base64(q: Column) -> Column:
    """base64 of int8 values, without line breaks."""
    return F.regexp_replace(F.base64(_bytes(q)), "[\\r\\n]", "")


def decode_bytes(text: Column) -> Column:
    """Bytes of base64 text with or without line breaks; empty where it can't be decoded or is null."""
    return F.coalesce(F.try_to_binary(F.regexp_replace(text, "[\\r\\n]", ""), F.lit("base64")), F.unhex(F.lit("")))


def _binary(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows as int8 values, and where each row begins and ends; null rows are empty."""
    sizes = pa.compute.binary_length(data).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(v for v in data.to_pylist() if v), np.int8), np.concatenate(([0], np.cumsum(sizes)))


@arrow_udf(T.ArrayType(T.ByteType()))
def _int8(data: pa.Array) -> pa.Array:
    flat, ends = _binary(data)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def decode_int8(text: Column) -> Column:
    """int8 values of base64 text; empty where it can't be decoded."""
    return _int8(decode_bytes(text))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix of two arrays, summed from left to right; -1 if one is empty or of norm zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = _zeroed(F.slice(a, 1, n)), _zeroed(F.slice(b, 1, n))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    xx, yy = total(F.transform(x, lambda e: e * e)), total(F.transform(y, lambda e: e * e))
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    return F.when((n > 0) & (xx > 0) & (yy > 0), F.try_divide(dot, F.sqrt(xx) * F.sqrt(yy))).otherwise(-1.0)


def _cosines(x: np.ndarray, x_ends: np.ndarray, y: np.ndarray, y_ends: np.ndarray) -> pa.Array:
    """Cosines of the rows of two flat arrays over their common prefixes; rows of one length are taken together."""
    out = np.full(len(x_ends) - 1, -1.0)
    size = np.minimum(np.diff(x_ends), np.diff(y_ends))
    for n in np.unique(size[size > 0]):
        for rows in np.array_split(np.flatnonzero(size == n), max(1, int((size == n).sum()) * int(n) // (1 << 22))):
            a, b = x[x_ends[rows][:, None] + np.arange(n)].astype(float), y[y_ends[rows][:, None] + np.arange(n)].astype(float)
            norm = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
            out[rows] = np.divide((a * b).sum(1), norm, out=np.full(len(rows), -1.0), where=norm > 0)
    return pa.array(out)


@arrow_udf(T.DoubleType())
def _cosine_bytes(a: pa.Array, b: pa.Array) -> pa.Array:
    return _cosines(*_binary(a), *_binary(b))


def cosine_bytes(a: Column, b: Column) -> Column:
    """:func:`cosine` of two binary columns of int8 values, a batch at a time."""
    return _cosine_bytes(a, b)


@arrow_udf(T.DoubleType())
def _cosine_query(query: pa.Array, vec: pa.Array) -> pa.Array:
    x = np.nan_to_num(query.flatten().to_numpy(zero_copy_only=False).astype(float))
    ends = np.concatenate(([0], np.cumsum(query.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    return _cosines(x, ends, *_binary(vec))


def cosine_query(query: Column, vec: Column) -> Column:
    """:func:`cosine` of an array of numbers and a binary column of int8 values; the scale of the latter doesn't matter."""
    return _cosine_query(query, vec)
