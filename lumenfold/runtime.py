"""What every operator needs of the session: the shared folder, written tables, sized joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a keyed side table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master one of our own where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = spark.conf.get("lumenfold.shared.dir", None)
    if not conf:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="lumenfold-")
        atexit.register(shutil.rmtree, conf, True)
        spark.conf.set("lumenfold.shared.dir", conf)
    return conf.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() returned and nobody reads any more."""
    for df in tables:
        if folder := getattr(df, "_written_to", None):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_sized(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a materialized side table: broadcast if its counted rows are few, else by a shuffle."""
    return big.join(F.broadcast(side) if side.count() <= rows else side, on, how)


def join_hot(big: DataFrame, side: DataFrame, on: str, weight: str, hot: int = 200_000) -> DataFrame:
    """Inner join with a materialized side table of one row a key; `weight` says how many rows of `big` have the key.

    Keys of more than `hot` rows are broadcast, so their rows are not sent to one task; there
    are at most total / hot of them.
    """
    heavy = side.where(F.col(weight) > hot)
    number = heavy.count()
    if not number or number > BROADCAST_ROWS:
        return join_sized(big, side, [on])
    few = F.broadcast(heavy)
    return big.join(few, on).unionByName(join_sized(big.join(F.broadcast(heavy.select(on)), on, "left_anti"), side.where(F.col(weight) <= hot), [on]))


def even_keys(spark: SparkSession, tasks: int) -> list[int]:
    """For each of `tasks` partitions an integer that repartition(tasks, column) sends there."""
    found: dict[int, int] = {}
    start, step = 0, 16 * tasks + 64
    while len(found) < tasks:
        at = F.col("id").cast("int")
        for r in spark.range(start, start + step).groupBy(F.pmod(F.hash(at), F.lit(tasks)).alias("part")).agg(F.min(at).alias("key")).collect():
            found.setdefault(r["part"], r["key"])
        start += step
    return [found[k] for k in range(tasks)]


def spread_groups(sizes: list[int], tasks: int) -> list[int]:
    """The task of every group: the largest first, each to the task that has least."""
    import heapq

    heap, out = [(0, t) for t in range(tasks)], [0] * len(sizes)
    for g in sorted(range(len(sizes)), key=lambda g: -sizes[g]):
        load, t = heapq.heappop(heap)
        out[g] = t
        heapq.heappush(heap, (load + sizes[g], t))
    return out


def tidy_key(col: Column) -> Column:
    """A source name without blanks and case; null and blank names become null."""
    out = F.lower(F.regexp_replace(col, r"[\s ]+", ""))
    return F.when(out != "", out)


def task_count(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
