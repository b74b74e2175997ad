"""File sources and sinks; a schema is always given, so no source is read twice to guess it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv")


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def read(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    r = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("escape", '"').option("multiLine", False)
    return r.load(path)


def rows_of_json(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A JSON array as rows (key, value struct)."""
    from pyspark.sql import functions as F

    return spark.range(1).select(F.posexplode(F.from_json(F.lit(text), f"array<{schema}>")).alias("key", "value"))
