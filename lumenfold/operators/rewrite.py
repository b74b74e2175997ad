"""Changes of tables as rewrites: insert, conditional insert, upsert, update, delete, checked load, limited row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_new(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """target with the rows whose key it has not (on conflict do nothing); of new rows with one key one stays."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], guard: Column | None = None) -> DataFrame:
    """target with rows put in by key; an existing row is replaced where `guard` holds.

    In guard the old columns have their names, the new ones the prefix new_. Keys must be
    unique on either side.
    """
    others = [c for c in target.columns if c not in key]
    new = rows.select(*key, *[F.col(c).alias(f"new_{c}") for c in others], F.lit(True).alias("_given"))
    both = target.withColumn("_there", F.lit(True)).join(new, key, "full_outer")
    take = F.col("_given").isNotNull() & (F.col("_there").isNull() | (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))))
    return both.select(*key, *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in others]).select(*target.columns)


def update_where(target: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def limited(df: DataFrame, limit: int = 100, ceiling: int = 1000) -> tuple[list, bool]:
    """The first rows, and whether there are more."""
    n = max(0, min(limit, ceiling))
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n
