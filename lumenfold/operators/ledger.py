"""A tamper-evident ledger: rows chained by hashes, appended in order, verified in parallel.

A row is (id, kind, payload, mac, prev_hash, entry_hash, actor). entry_hash is the SHA-256
of previous hash, payload and mac; mac is an HMAC-SHA-256 of the payload where a key is
set. Appending is sequential by nature and happens on the driver, batch by batch;
verifying compares every row with its predecessor's hash, all rows at once.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.runtime import shared_dir

SCHEMA = "id bigint, kind int, payload string, mac string, prev_hash string, entry_hash string, actor string"
GENESIS = "00" * 32
TRUTH, AUDIT, SHADOW = 1, 2, 3


def entry_hash(prev_hash: str, payload: str, mac: str) -> str:
    return hashlib.sha256(bytes.fromhex(prev_hash) + payload.encode() + bytes.fromhex(mac)).hexdigest()


def hmac_column(key: bytes, text: Column) -> Column:
    """HMAC-SHA-256 of a text as hex, by two nested hashes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def chain(payloads: list[str], kind: int, first_id: int = 1, prev_hash: str = GENESIS, key: bytes | None = None, actor: str = "") -> list[tuple]:
    rows = []
    for k, p in enumerate(payloads):
        mac = hmac.new(key, p.encode(), hashlib.sha256).hexdigest() if key else ""
        h = entry_hash(prev_hash, p, mac)
        rows.append((first_id + k, kind, p, mac, prev_hash, h, actor))
        prev_hash = h
    return rows


def chain_frame(df: DataFrame, id: str, payload: str, kind: int | Column) -> DataFrame:
    """Ledger rows of a table, in the order of its ids: every kind has a chain of its own, and a task.

    A chain has no parallel form, so a kind should be a bounded batch (as appended, one key's worth).
    """
    def run(pdf):
        pdf = pdf.sort_values("id")
        import pandas as pd

        return pd.DataFrame(chain(pdf["payload"].tolist(), int(pdf["kind"].iloc[0])), columns=[c.split()[0] for c in SCHEMA.split(", ")]).assign(id=pdf["id"].to_numpy())

    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(payload).alias("payload"), (F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"))
    return rows.groupBy("kind").applyInPandas(run, SCHEMA)


def verify(rows: DataFrame, kind: int | None = None, key: bytes | None = None, watermark: int = 0) -> DataFrame:
    """One row (ok, rows_verified, first_failure_id, reason): the first broken row by id, if any.

    Checks every row's link to the row before it of its kind, its recomputed hash, its mac
    where a key is given, ids missing from the whole ledger, and that at least `watermark`
    rows are there. Windows run per kind and block of ids; only the last row of every
    block is looked at across blocks.
    """
    mine = rows if kind is None else rows.where(F.col("kind") == kind)
    block = F.floor(F.col("id") / 65536)
    tips = mine.groupBy("kind", block.alias("block")).agg(F.max_by("entry_hash", "id").alias("tip"))
    tips = tips.withColumn("before", F.lag("tip").over(Window.partitionBy("kind").orderBy("block"))).select("kind", "block", "before")
    w = Window.partitionBy("kind", "block").orderBy("id")
    r = mine.withColumn("block", block).withColumn("prior", F.lag("entry_hash").over(w)).join(tips, ["kind", "block"]).withColumn("prior", F.coalesce("prior", "before", F.lit(GENESIS)))
    computed = F.sha2(F.concat(F.unhex("prev_hash"), F.encode("payload", "UTF-8"), F.unhex("mac")), 256)
    reason = F.when(F.col("prev_hash") != F.col("prior"), "broken link").when(F.col("entry_hash") != computed, "hash mismatch")
    if key is not None:
        reason = reason.when(F.col("mac") != hmac_column(key, F.col("payload")), "bad signature")
    bad = r.select("id", reason.alias("reason"))
    seen = rows.agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = bad.agg(F.count(F.lit(1)).alias("rows_verified"), F.min(F.when(F.col("reason").isNotNull(), F.struct("id", "reason"))).alias("f"))
    missing = (F.col("n") < F.col("last") - F.col("first") + 1) if kind is None else F.lit(False)
    wiped = F.coalesce(F.col("last"), F.lit(0)) < watermark
    problem = F.when(F.col("f").isNotNull(), F.col("f.reason")).when(wiped, "rows are gone").when(missing, "ids are missing")
    return out.crossJoin(seen).select(problem.isNull().alias("ok"), "rows_verified", F.col("f.id").alias("first_failure_id"), problem.alias("reason"))


def latest_per_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.max("id").alias("id"), F.max_by("payload", "id").alias("payload"), F.max_by("entry_hash", "id").alias("entry_hash"))


@dataclass
class Ledger:
    """The ledger of one folder, with session settings (actor, key, latch) and pending feedback."""

    spark: SparkSession
    path: str | None = None
    key: bytes | None = None
    actor: str = ""
    locked: bool = False
    watermark: int = 0
    epoch: int = 1
    truth: list[dict] = field(default_factory=list)
    shadow: list[dict] = field(default_factory=list)
    version: int = 0

    def __post_init__(self) -> None:
        self.path = self.path or f"{shared_dir(self.spark)}/ledger"

    def rows(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA + ", batch bigint").option("basePath", self.path).parquet(self.path).drop("batch")

    def append(self, payloads: list[str], kind: int) -> int:
        """Append rows to the chain of a kind; raises if another writer has appended in the meantime.

        A batch is written under the name of the id it begins with: of two writers that read
        the same tip only one can make that folder.
        """
        rows = self.rows()
        last = rows.agg(F.max("id")).head()[0] or 0
        tip = rows.where(F.col("kind") == kind).agg(F.max_by("entry_hash", "id")).head()[0] or GENESIS
        new = chain(payloads, kind, last + 1, tip, self.key, self.actor)
        if new:
            try:
                self.spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/batch={last + 1}")
            except Exception as e:
                if "ALREADY_EXISTS" in str(e):
                    raise RuntimeError("another writer has appended to this ledger") from None
                raise
            self.watermark = new[-1][0]
        return len(new)

    def audit_log(self, type: str, payload: str, redact: tuple[str, ...] = ()) -> None:
        """Append an audit row; payload is JSON and must not claim an actor itself."""
        try:
            body = json.loads(payload)
        except ValueError:
            raise ValueError("payload is no valid JSON") from None
        if isinstance(body, dict):
            if "_actor" in body:
                raise ValueError("_actor is reserved")
            body = {k: ("***" if k in redact else v) for k, v in body.items()}
        self.append([json.dumps({"type": type, "payload": body, "_actor": self.actor}, sort_keys=True)], AUDIT)

    def set_actor(self, name: str) -> None:
        self.actor = name

    def lock_destructive(self) -> None:
        self.locked = True

    def _free(self) -> None:
        if self.locked:
            raise PermissionError("destructive ledger functions are locked in this session")

    def report(self, doc_id: int, signal: str, ms: int | None = None) -> None:
        """Feedback on a result: dwell and positive go to the truth, negative to the shadow."""
        if doc_id < 0 or signal not in ("dwell", "positive", "negative"):
            raise ValueError("handle must be >= 0, the signal dwell, positive or negative")
        entry = {"epoch": self.epoch, "doc_id": doc_id, "signal": signal} | ({"ms": ms} if ms is not None else {})
        (self.shadow if signal == "negative" else self.truth).append(entry)

    def flush(self) -> int:
        """Append the pending state, one row per kind that has any."""
        self._free()
        n = 0
        for kind, items in ((TRUTH, self.truth), (SHADOW, self.shadow)):
            if items:
                n += self.append([json.dumps(items, sort_keys=True)], kind)
        return n

    def load(self) -> None:
        """Restore the state from the last row of each kind, after checking that row's hash and signature."""
        for r in latest_per_kind(self.rows()).collect():
            tip = self.rows().where((F.col("kind") == r["kind"]) & (F.col("id") == r["id"])).head()
            if entry_hash(tip.prev_hash, tip.payload, tip.mac) != tip.entry_hash:
                raise ValueError("the last row of the ledger is damaged")
            if self.key and not tip.mac:
                raise ValueError("an unsigned row under a key")
            if self.key and hmac.new(self.key, tip.payload.encode(), hashlib.sha256).hexdigest() != tip.mac:
                raise ValueError("bad signature")
            if r["kind"] == TRUTH:
                self.truth = json.loads(r["payload"])
            elif r["kind"] == SHADOW:
                self.shadow = json.loads(r["payload"])

    def compact(self) -> int:
        """Drop superseded entries: of repeated signals on one document the last stays; what stays becomes the stored state."""
        self._free()
        before = len(self.truth) + len(self.shadow)
        self.truth = list({(e["doc_id"], e["signal"]): e for e in self.truth}.values())
        self.shadow = list({e["doc_id"]: e for e in self.shadow}.values())
        gone = before - len(self.truth) - len(self.shadow)
        if gone:
            for kind, items in ((TRUTH, self.truth), (SHADOW, self.shadow)):
                self._store(kind, items)
        return gone

    def _store(self, kind: int, items: list[dict]) -> None:
        """Make `items` the stored state of a kind where another one is stored."""
        text = json.dumps(items, sort_keys=True)
        stored = self.rows().where(F.col("kind") == kind).agg(F.max_by("payload", "id")).head()[0]
        if stored is not None and stored != text:
            self.append([text], kind)

    def reset_soft(self) -> None:
        """Forget the shadow; the empty state is appended, so loading does not bring it back."""
        self._free()
        self.shadow = []
        self._store(SHADOW, [])

    def reset_hard(self) -> None:
        self._free()
        self.truth, self.shadow, self.epoch = [], [], 1
        self._store(TRUTH, [])
        self._store(SHADOW, [])

    def verify(self, kind: int | None = None) -> dict:
        return verify(self.rows(), kind, self.key, self.watermark).head().asDict()


def unpack(payload: str) -> list[dict]:
    """Feedback entries (epoch, doc_id, signal) of a state row."""
    return [{k: e.get(k) for k in ("epoch", "doc_id", "signal")} for e in json.loads(payload)]
