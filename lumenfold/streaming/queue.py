"""The embedding queue: rows whose text waits for a vector, as tables in batch or as a stream.

Queue rows are (queue_id, vectorizer_id, pk, status, updated_at, error). All transitions are
rewrites of a DataFrame; the embedder runs inside the tasks, over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.runtime import materialize

QUEUE = "vectorizer_id int, pk bigint, status string, updated_at bigint, error string"
DONE_KEEP_SECS, FAILED_KEEP_SECS = 3600, 86400


def backfill(source: DataFrame, pk: str, text: str, emb: str | None, vectorizer_id: int, queue: DataFrame | None, now: int) -> DataFrame:
    """New pending rows: a text, no vector, and no pending row of the same key yet."""
    rows = source.where(F.col(text).isNotNull() & (F.col(emb).isNull() if emb else F.lit(True)))
    new = rows.select(F.lit(vectorizer_id).alias("vectorizer_id"), F.col(pk).cast("bigint").alias("pk"), F.lit("pending").alias("status"), F.lit(now).cast("bigint").alias("updated_at"), F.lit(None).cast("string").alias("error")).dropDuplicates(["pk"])
    if queue is None:
        return new
    waiting = queue.where(F.col("status").isin("pending", "processing")).select("vectorizer_id", "pk")
    return new.join(waiting, ["vectorizer_id", "pk"], "left_anti")


def reclaim_stale(queue: DataFrame, now: int, stale_secs: int = 600) -> DataFrame:
    """Rows that have been processing for longer than `stale_secs` are pending again."""
    old = (F.col("status") == "processing") & (F.lit(now) - F.col("updated_at") > stale_secs)
    return queue.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def claim_oldest(queue: DataFrame, registry: DataFrame, batch: int, now: int) -> DataFrame:
    """The `batch` oldest pending rows of enabled vectorizers, marked processing."""
    live = queue.where("status = 'pending'").join(F.broadcast(registry.where("enabled").select("vectorizer_id")), "vectorizer_id", "left_semi")
    return live.orderBy("updated_at", "vectorizer_id", "pk").limit(batch).withColumn("status", F.lit("processing")).withColumn("updated_at", F.lit(now).cast("bigint"))


def rate_allowed(used: int, window_start: int, now: int, cap: int | None, window_secs: int = 3600) -> tuple[int, int]:
    """(how many may be embedded now, start of the window): the window begins anew when more than its length has passed."""
    if cap is None:
        return 1 << 31, window_start
    if now - window_start > window_secs:
        used, window_start = 0, now
    return max(0, cap - used), window_start


def retain(queue: DataFrame, now: int) -> DataFrame:
    """Without rows done for over an hour or failed for over a day."""
    age = F.lit(now) - F.col("updated_at")
    return queue.where(~(((F.col("status") == "done") & (age > DONE_KEEP_SECS)) | ((F.col("status") == "failed") & (age > FAILED_KEEP_SECS))))


def status_view(queue: DataFrame, registry: DataFrame) -> DataFrame:
    """Per vectorizer: counts by status, time and text of the last error."""
    q = queue.groupBy("vectorizer_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "failed")],
                                          F.max(F.when(F.col("status") == "failed", F.col("updated_at"))).alias("last_error_at"),
                                          F.max_by("error", F.when(F.col("status") == "failed", F.col("updated_at"))).alias("last_error"))
    return registry.join(q, "vectorizer_id", "left").na.fill(0, ["pending", "processing", "done", "failed"])


def embed_column(embedder: Callable[[str], list[float]]) -> Callable[[Column], Column]:
    """struct<v, error>: the embedder over Arrow batches; a text it fails on gives the error instead."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                try:
                    out.append((None if t is None else [float(x) for x in embedder(t)], None))
                except Exception as e:  # one bad text does not fail its batch
                    out.append((None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["v", "error"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "struct<v:array<float>,error:string>")


@dataclass
class Vectorizer:
    """A registry of (table, text, vector) triples with their queue; state in tables of the shared folder."""

    spark: SparkSession
    embedder: Callable[[str], list[float]]
    registry: dict[int, dict] = field(default_factory=dict)
    queue: DataFrame | None = None
    used: dict[int, tuple[int, int]] = field(default_factory=dict)

    def create(self, source: DataFrame, name: str, pk: str, text: str, emb: str, now: int, cap: int | None = None, window_secs: int = 3600) -> int:
        """Register a triple and queue its rows that have a text and no vector; returns its id."""
        if any((v["name"], v["text"], v["emb"]) == (name, text, emb) for v in self.registry.values()):
            raise ValueError("this vectorizer exists")
        k = max(self.registry, default=0) + 1
        self.registry[k] = {"name": name, "pk": pk, "text": text, "emb": emb, "enabled": True, "source": source, "cap": cap, "window_secs": window_secs}
        self._put(backfill(source, pk, text, emb, k, self.queue, now))
        return k

    def _put(self, new: DataFrame) -> None:
        self.queue = materialize(new if self.queue is None else self.queue.unionByName(new), "queue")

    def _known(self, k: int) -> dict:
        if k not in self.registry:
            raise KeyError(f"no vectorizer {k}")
        return self.registry[k]

    def pause(self, k: int) -> None:
        self._known(k)["enabled"] = False

    def resume(self, k: int) -> None:
        self._known(k)["enabled"] = True

    def drop(self, k: int) -> None:
        self._known(k)
        del self.registry[k]
        self.queue = materialize(self.queue.where(F.col("vectorizer_id") != k), "queue")

    def enqueue(self, k: int, changed: DataFrame, now: int) -> None:
        v = self._known(k)
        self._put(backfill(changed, v["pk"], v["text"], None, k, self.queue, now))

    def registry_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(k, v["name"], v["enabled"]) for k, v in self.registry.items()], "vectorizer_id int, name string, enabled boolean")

    def process_queue(self, now: int, batch: int = 85, stale_secs: int = 600) -> tuple[int, DataFrame | None]:
        """Embed the oldest pending rows: (number done, (vectorizer_id, pk, embedding) of this call)."""
        if self.queue is None or not self.registry:
            return 0, None
        queue = retain(reclaim_stale(self.queue, now, stale_secs), now)
        claimed = materialize(claim_oldest(queue, self.registry_frame(), batch, now), "claimed")
        results, allowed = None, None
        for k, v in self.registry.items():
            free, start = rate_allowed(*self.used.get(k, (0, now)), now, v["cap"], v["window_secs"])
            mine = claimed.where(F.col("vectorizer_id") == k).orderBy("pk").limit(min(free, batch))
            # of a key delivered twice one row; a claimed key whose row or text is gone fails, or it would be claimed for ever
            source = v["source"].select(F.col(v["pk"]).cast("bigint").alias("pk"), F.col(v["text"]).alias("text")).join(F.broadcast(mine.select("pk")), "pk", "left_semi")
            found = mine.join(source.groupBy("pk").agg(F.max("text").alias("text")), "pk", "left")
            there = found.where("text is not null").select("vectorizer_id", "pk", embed_column(self.embedder)(F.col("text")).alias("e")).select("vectorizer_id", "pk", "e.v", "e.error")
            texts = there.unionByName(found.where("text is null").select("vectorizer_id", "pk", F.lit(None).cast("array<float>").alias("v"), F.lit("the row is gone").alias("error")))
            results = texts if results is None else results.unionByName(texts)
            allowed = mine.select("vectorizer_id", "pk") if allowed is None else allowed.unionByName(mine.select("vectorizer_id", "pk"))
            self.used[k] = (self.used.get(k, (0, now))[0] if start == self.used.get(k, (0, now))[1] else 0, start)
        results = materialize(results, "embedded")
        for r in results.where("error is null").groupBy("vectorizer_id").count().collect():
            used, start = self.used[r["vectorizer_id"]]
            self.used[r["vectorizer_id"]] = (used + r["count"], start)
        ended = results.select("vectorizer_id", "pk", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("s"), F.col("error").alias("x"))
        over = queue.join(ended, ["vectorizer_id", "pk"], "left")
        pending = F.col("status").isin("pending", "processing")
        self.queue = materialize(over.select("vectorizer_id", "pk", F.when(F.col("s").isNotNull() & pending, F.col("s")).otherwise(F.col("status")).alias("status"),
                                             F.when(F.col("s").isNotNull() & pending, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")).alias("updated_at"),
                                             F.when(F.col("s").isNotNull() & pending, F.col("x")).otherwise(F.col("error")).alias("error")), "queue")
        done = results.where("error is null")
        return done.count(), done.select("vectorizer_id", "pk", F.col("v").alias("embedding"))


def embed_stream(stream: DataFrame, pk: str, text: str, embedder: Callable[[str], list[float]], out: str, checkpoint: str, at: str | None = None, late: str = "10 minutes") -> StreamingQuery:
    """Embed the rows of a stream as they come, each key once within the watermark, into parquet files."""
    rows = stream.where(F.col(text).isNotNull())
    rows = rows.withWatermark(at, late).dropDuplicatesWithinWatermark([pk]) if at else rows.dropDuplicates([pk])
    embedded = rows.select(F.col(pk), embed_column(embedder)(F.col(text)).alias("e")).select(pk, "e.v", "e.error")
    return embedded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


__all__ = ["QUEUE", "Vectorizer", "backfill", "claim_oldest", "embed_stream", "rate_allowed", "reclaim_stale", "retain", "status_view"]
