"""Vector functions as Spark expressions over arrays.

Every function takes columns of numeric arrays, computes in double, and is null where an
argument is null. Vectors of different lengths raise an error; a zero norm gives cosine
distance 1 and similarity 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIM = 32767


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def lit_vector(values: list[float]) -> Column:
    """A constant vector: one array literal of the plan."""
    return F.lit(np.asarray(values, dtype=np.float64))


def _pair(a: Column, b: Column, f) -> Column:
    same = F.size(a) == F.size(b)
    out = F.aggregate(F.zip_with(doubles(a), doubles(b), f), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(same, out).otherwise(F.raise_error(F.lit("vector dim mismatch")).cast("double"))


def zeros(dim: int) -> Column:
    if not 1 <= dim <= MAX_DIM:
        raise ValueError(f"dim must be in 1..{MAX_DIM}")
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def from_text(t: Column) -> Column:
    """'1,2' or '[1,2]' as array<float>; malformed text raises an error under ANSI mode."""
    inner = F.regexp_replace(t, r"[\[\]\s]", "")
    return F.transform(F.split(inner, ","), lambda x: x.cast("float"))


def to_json(v: Column) -> Column:
    return F.to_json(v.cast("array<float>"))


def dims(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(v))


def dot(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda x, y: x * y)


def l2_squared(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def cosine_distance_to(v: Column, query: list[float]) -> Column:
    """cosine_distance to a constant vector, whose norm is computed once."""
    n = norm(v) * F.lit(float(np.linalg.norm(np.asarray(query, dtype=np.float64))))
    return F.lit(1.0) - F.when(n == 0, 0.0).otherwise(dot(v, lit_vector(query)) / F.nullif(n, F.lit(0.0)))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def lp_distance(a: Column, b: Column, p: float) -> Column:
    if not p > 0:
        raise ValueError("p must be positive")
    return F.pow(_pair(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def scale(v: Column, s: float) -> Column:
    return F.transform(doubles(v), lambda x: x * F.lit(float(s)))


def normalize(v: Column) -> Column:
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n == 0, 0.0).otherwise(x / F.nullif(n, F.lit(0.0))))


def weighted_concat(a: Column, b: Column, alpha: float) -> Column:
    return F.concat(scale(a, alpha), scale(b, 1 - alpha))


def int8_scale(v: Column) -> Column:
    """Scale of the symmetric 8-bit form: v is about code * scale; 0 for the zero vector."""
    return F.array_max(F.transform(doubles(v), lambda x: F.abs(x))) / 127.0


def quantize_int8(v: Column) -> Column:
    """struct<scale, codes>: codes in -127..127, halves away from zero."""
    s = int8_scale(v)
    codes = F.transform(doubles(v), lambda x: F.when(s == 0, 0.0).otherwise(F.signum(x) * F.floor(F.abs(x) / F.nullif(s, F.lit(0.0)) + 0.5)).cast("tinyint"))
    return F.struct(s.alias("scale"), codes.alias("codes"))


def binary_text(v: Column) -> Column:
    """One character per element: 1 where it is at least 0."""
    return F.array_join(F.transform(doubles(v), lambda x: F.when(x >= 0, "1").otherwise("0")), "")


def quantize_binary(v: Column) -> Column:
    """One bit per element (1 where at least 0), first element highest, padded with zeros to whole bytes."""
    def pack(col: pd.Series) -> pd.Series:
        return _same_length(col, lambda x: np.packbits(x >= 0, axis=1))

    return F.pandas_udf(pack, "binary")(doubles(v))


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing bits of two packed vectors of the same length."""
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), None, dtype=object)
        there = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        p, q = x.to_numpy()[there], y.to_numpy()[there]
        sizes = np.array([len(r) for r in p], dtype=np.int64)
        if (sizes == 0).any() or any(len(r) != n for r, n in zip(q, sizes)):
            raise ValueError("packed vectors differ in length or are empty")
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            bits = np.frombuffer(b"".join(p[at]), dtype=np.uint8) ^ np.frombuffer(b"".join(q[at]), dtype=np.uint8)
            out[there[at]] = np.bitwise_count(bits.reshape(-1, n)).sum(axis=1, dtype=np.int64).tolist()
        return pd.Series(out)

    return F.pandas_udf(count, "int")(a, b)


def _same_length(col: pd.Series, f) -> pd.Series:
    """f over the rows stacked by length, as bytes; null stays null."""
    out = np.full(len(col), None, dtype=object)
    there = np.flatnonzero(col.notna().to_numpy())
    rows = col.to_numpy()[there]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for k, r in zip(there[at], f(np.stack(rows[at]).reshape(len(at), n))):
            out[k] = r.tobytes()
    return pd.Series(out)
