"""Usable vectors of a table, as arrays in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: Column, dim: int) -> Column:
    """Not null, of length `dim`, without null, NaN or infinite elements, and not all zero."""
    ok = (F.size(col) == dim) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(col, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def usable_vectors(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(key, vec array<float>) of the rows whose key is there and whose vector is usable; copies are kept."""
    return df.select(F.col(key).alias("key"), F.col(vec).cast("array<float>").alias("vec")).where(F.col("key").isNotNull() & usable(F.col("vec"), dim))


def matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(col.to_numpy()).reshape(-1, dim).astype(np.float32) if len(col) else np.empty((0, dim), dtype=np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (float32, computed in double)."""
    y = x.astype(np.float64)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)
