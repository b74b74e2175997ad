"""Event streams: windows by event time, sessions, duplicates, and stateful cycle detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.functions.kernels import CycleDetector
from lumenfold.runtime import shared_dir


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sliding_means(stream: DataFrame, at: str, value: str, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step)).agg(F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "mean")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    # session_window joins rows that are exactly its gap apart; here a gap of that length begins a session
    s = stream.withWatermark(at, late).groupBy(key, F.session_window(at, f"{gap} -1 microsecond")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), "n")


def without_duplicates(stream: DataFrame, id: str, at: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id])


class CycleState(StatefulProcessor):
    """Brent's detector per key: three numbers of state, armed again after every cycle found."""

    def __init__(self, hamming: int = 0):
        self.hamming = hamming

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detector", "power int, lam int, checkpoint binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        d = CycleDetector(self.hamming)
        if self.state.exists():
            power, lam, checkpoint = self.state.get()
            d = CycleDetector(self.hamming, power, lam, None if checkpoint is None else bytes(checkpoint))
        found = []
        # in order across the Arrow batches of a key, whatever their size
        for o, s in sorted((int(o), bytes(s)) for pdf in rows for o, s in zip(pdf["ord"], pdf["state"])):
            if n := d.feed(s):
                found.append((key[0], o, n))
        self.state.update((d.power, d.lam, d.checkpoint))
        yield pd.DataFrame(found, columns=["key", "ord", "cycle_len"])

    def close(self) -> None:
        pass


def cycles(stream: DataFrame, key: str, order: str, state: str, hamming: int = 0) -> DataFrame:
    """(key, ord, cycle_len): every cycle that a key's fingerprints close, over the whole stream.

    Sets the session's state store to RocksDB, which keeps state outside the heap.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("ord"), F.col(state).cast("binary").alias("state"))
    return rows.groupBy("key").transformWithStateInPandas(CycleState(hamming), "key string, ord bigint, cycle_len int", "append", "none")


def run_to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder, and return it; it is also the view `name`.

    The tasks write the rows, so the driver holds none. In complete mode a batch replaces the one before.
    """
    import uuid

    path, written = f"{shared_dir(spark)}/lumenfold/stream-{uuid.uuid4().hex}", {}

    def write(batch: DataFrame, k: int) -> None:
        at = f"{path}/{'all' if mode == 'complete' else k}"
        batch.write.mode("overwrite").parquet(at)  # a batch that is run again replaces itself
        written[at] = k

    q = df.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(df.schema).parquet(*written) if written else spark.createDataFrame([], df.schema)
    out.createOrReplaceTempView(name)
    return out


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there now into parquet files, exactly once."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


__all__ = ["CycleState", "cycles", "read_stream", "run_to_files", "run_to_table", "sessions", "sliding_means", "tumbling_counts", "without_duplicates"]
