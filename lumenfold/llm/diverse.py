"""A varied subset of given size: distributed farthest-first k-center.

Every task runs farthest-first selection over its rows, batch by batch, and keeps its k
representatives; the representatives are pooled over a tree of at most `fan_in` tasks'
worth each, and farthest-first over the last pool gives the subset. Each level is a
composable core-set for k-center, so the result covers all rows within a constant factor
of the best possible radius. The picks come in order: a prefix of them is the subset of
that smaller size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.vectors import matrix, usable
from lumenfold.runtime import materialize


def tidy_kind(col: Column) -> Column:
    """A kind or category in one spelling: lower case, parted by hyphens; null and blank are ''."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(F.regexp_replace(col.cast("string"), r"[\s_\- ]+", " "))), " ", "-"), F.lit(""))


def farthest_first(x: np.ndarray, kind: np.ndarray, k: int, kind_weight: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows chosen, in order, and the distance of each to those chosen before it (NaN for the first).

    Squared distance: between the vectors, plus kind_weight^2 where the kinds differ. Ties
    go to the earliest row. Stops early when only copies of chosen rows are left.
    """
    n = len(x)
    gap = np.full(n, np.inf)
    picked, radius = [], []
    at = first
    for _ in range(min(k, n)):
        picked.append(at)
        radius.append(float(np.sqrt(gap[at])) if picked[:-1] else np.nan)
        d = ((x - x[at]) ** 2).sum(axis=1, dtype=np.float64) + kind_weight**2 * (kind != kind[at])
        np.minimum(gap, d, out=gap)
        at = int(gap.argmax())
        if gap[at] <= 0:
            break
    return np.array(picked, dtype=np.int64), np.array(radius)


def varied_subset(df: DataFrame, id: str, vec: str, kind: str, dim: int, k: int, kind_weight: float = 1.0, fan_in: int = 64, oversample: int = 2) -> DataFrame:
    """(id, kind, rank, radius): k varied rows, rank 1 first; radius is the distance to those before (null for the first).

    Rows with a null id or an unusable vector cannot be chosen; a null kind counts as a kind
    of its own; kinds are told apart without case and separators. Rows delivered twice are
    one. Fewer than k rows come out only if fewer distinct (vector, kind) exist. k <= 0 and
    empty tables give no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("id"), tidy_kind(F.col(kind)).alias("kind"), F.col(vec).cast("array<float>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec"), dim))
    kept = k * oversample  # what a task keeps: more than k brings the pooled choice close to one over all rows
    schema = f"id {df.schema[id].dataType.simpleString()}, kind string, vec array<float>, radius double"

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf[["id", "kind", "vec"]]
            held = pdf if held is None else pd.concat([held, pdf])
            if len(held) > 8 * kept + 20_000:
                held = reduce(held, kept)
        if held is not None and len(held):
            yield reduce(held, kept)

    def reduce(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        at, radius = farthest_first(matrix(pdf["vec"], dim), pdf["kind"].to_numpy(), k, kind_weight, 0)
        return pdf.iloc[at].assign(radius=radius)

    if k <= 0:
        return rows.limit(0).select(F.col("id").alias(id), "kind", F.lit(0).alias("rank"), F.lit(0.0).alias("radius"))
    pool = materialize(rows.mapInPandas(select, schema), "pool")
    parts = pool.count() // kept + 1
    while parts > fan_in:
        parts = -(-parts // fan_in)
        pool = materialize(pool.repartition(parts, "id").mapInPandas(select, schema), "pool")
    last = pool.repartition(1).mapInPandas(lambda it: (reduce(p, k)[["id", "kind", "radius"]].assign(rank=lambda q: np.arange(1, len(q) + 1)) for p in [pd.concat(list(it) or [pd.DataFrame({"id": [], "kind": [], "vec": []})])] if len(p)),
                                           f"id {df.schema[id].dataType.simpleString()}, kind string, radius double, rank int")
    return last.select(F.col("id").alias(id), "kind", "rank", F.nanvl("radius", F.lit(None).cast("double")).alias("radius"))
