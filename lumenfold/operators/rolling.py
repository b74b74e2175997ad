"""Rolling totals over trailing periods, one row per entity and calendar day.

Daily totals come from a partial aggregation, so a hot entity is summed before the
shuffle. The calendar is cut into blocks of `block_days`; the window's partition is
(entity, block), with the trailing days of the block before copied into it, so the
longest history of one entity never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: str, day: str, value: str, decimals: int = 2) -> DataFrame:
    """(entity, day, cents): exact integer totals; rows equal in all three fields count once.

    A row with a null (or NaN) in any of the three fields counts for nothing.
    """
    number = F.col(value).cast("double")
    rows = df.select(F.col(entity).cast("bigint").alias("entity"), F.col(day).cast("bigint").alias("day"),
                     F.when(~F.isnan(number) & (F.abs(number) != float("inf")), F.round(number * 10**decimals).cast("bigint")).alias("cents"))
    return rows.dropna().distinct().groupBy("entity", "day").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("bookings"))


def rolling_totals(df: DataFrame, entity: str, day: str, value: str, periods: tuple[int, ...] = (7, 30),
                   decimals: int = 2, block_days: int = 1024) -> DataFrame:
    """Totals and averages of `value` over the trailing `periods`, days without rows included.

    One row per entity and day from its first to its last day: entity, day, units (the
    day's own total), first_day, and for each period n total_n and avg_n = total_n / n
    (the denominator is n also where the history is shorter). Empty input gives no rows;
    repeated rows count once; nulls and NaN count for nothing.
    """
    longest = max(periods)
    if block_days < longest:
        raise ValueError("block_days must be at least the longest period")
    scale = float(10**decimals)
    daily = daily_totals(df, entity, day, value, decimals)
    span = daily.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    block = F.floor(F.col("day") / block_days).cast("bigint")
    calendar = (span.select("*", F.explode(F.sequence(F.floor(F.col("first_day") / block_days), F.floor(F.col("last_day") / block_days))).alias("block"))
                .select("entity", "first_day", F.col("block").cast("bigint"),
                        F.explode(F.sequence(F.greatest("first_day", F.col("block") * block_days),
                                             F.least("last_day", (F.col("block") + 1) * block_days - 1))).alias("day"),
                        F.lit(0).cast("bigint").alias("cents"), F.lit(True).alias("shown")))
    own = daily.select("entity", F.lit(None).cast("bigint").alias("first_day"), block.alias("block"), "day", "cents", F.lit(False).alias("shown"))
    carried = own.where(F.pmod("day", F.lit(block_days)) >= block_days - longest + 1).withColumn("block", F.col("block") + 1)
    rows = calendar.unionByName(own).unionByName(carried)
    by = Window.partitionBy("entity", "block").orderBy("day")
    sums = [F.sum("cents").over(by.rangeBetween(1 - n, 0)).alias(f"s{n}") for n in periods]
    out = rows.select("entity", "day", "first_day", "shown", F.sum("cents").over(by.rangeBetween(0, 0)).alias("s0"), *sums).where("shown")
    return out.select(F.col("entity").alias(entity), F.col("day").alias(day), "first_day", (F.col("s0") / scale).alias(value),
                      *[(F.col(f"s{n}") / scale).alias(f"total_{n}") for n in periods],
                      *[F.round(F.col(f"s{n}") / scale / n, 6).alias(f"avg_{n}") for n in periods])


def surges(rolled: DataFrame, entity: str, day: str, short: int = 7, long: int = 30) -> DataFrame:
    """Entity-days with a full long period whose total is above zero and more than half of which fell in the short one."""
    s, n = F.round(F.col(f"total_{short}") * 100), F.round(F.col(f"total_{long}") * 100)
    return rolled.where((F.col(day) >= F.col("first_day") + long - 1) & (n > 0) & (2 * s > n)).select(entity, day)
