"""Ledger, queue, session, agent, text-to-SQL and streaming queries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import agents as A
from lumenfold.operators import ledger as L
from lumenfold.operators import text_to_sql as T
from lumenfold.plans.relational import SQL as RELATIONAL_SQL
from lumenfold.plans.relational import views
from lumenfold.plans.series_queries import BEST_PAIR_SQL, brent_sql
from lumenfold.plans.series_queries import SQL as SERIES_SQL
from lumenfold.plans.series_queries import drift_sql, hourly
from lumenfold.plans.vector_queries import COS, L2, WITH_Q, embeddings, mmr_sql, query_vector
from lumenfold.runtime import shared_dir
from lumenfold.session import Session
from lumenfold.sources.tables import table
from lumenfold.streaming import events as E
from lumenfold.streaming import queue as Q

NOW = 1_700_000_000


def _one(spark: SparkSession, row: dict) -> DataFrame:
    """A result of fixed size (one row of figures) as a DataFrame of rounded columns."""
    flat = {k: (json.dumps(v, default=str) if isinstance(v, (list, dict)) else round(v, 6) if isinstance(v, float) else v) for k, v in row.items()}
    return spark.createDataFrame([flat])


# ---- ledger: the customers' names as payloads, one chain for each nation

def _ledger_rows(spark: SparkSession, folder: str) -> DataFrame:
    return L.chain_frame(table(spark, folder, "customer"), "c_custkey", "c_name", F.col("c_nationkey"))


def ledger_chain(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger_rows(spark, folder).select("id", "payload", "entry_hash")


def ledger_verify_ok(spark: SparkSession, folder: str) -> DataFrame:
    return L.verify(_ledger_rows(spark, folder))


def ledger_verify_tampered(spark: SparkSession, folder: str) -> DataFrame:
    return L.verify(_ledger_rows(spark, folder).withColumn("payload", F.when(F.col("id") == 7, "changed").otherwise(F.col("payload"))))


def ledger_verify_gap(spark: SparkSession, folder: str) -> DataFrame:
    return L.verify(_ledger_rows(spark, folder).where("id <> 7"))


def ledger_latest_per_kind(spark: SparkSession, folder: str) -> DataFrame:
    return L.latest_per_kind(_ledger_rows(spark, folder)).select("kind", "id", "payload")


def ledger_hmac(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", L.hmac_column(b"k1", F.col("c_name")).alias("mac"))


def ledger_reset(spark: SparkSession, folder: str) -> DataFrame:
    """What is loaded after feedback, after compaction, after a soft and after a hard reset, by a new session each time."""
    path = f"{shared_dir(spark)}/lumenfold/ledger-{uuid.uuid4().hex}"
    g = L.Ledger(spark, path)
    for doc, signal in ((1, "positive"), (1, "positive"), (2, "dwell"), (3, "negative")):
        g.report(doc, signal)
    g.flush()
    out = []
    for step in ("flushed", "compacted", "soft", "hard"):
        if step != "flushed":
            {"compacted": g.compact, "soft": g.reset_soft, "hard": g.reset_hard}[step]()
        other = L.Ledger(spark, path)
        other.load()
        out.append((step, len(other.truth), len(other.shadow), other.verify()["ok"]))
    return spark.createDataFrame(out, "step string, truth int, shadow int, ok boolean")


# ---- queue over the documents

def _queue(spark: SparkSession, folder: str) -> DataFrame:
    """A queue of all documents with text: by the remainder of their id pending, processing, done or failed."""
    d = table(spark, folder, "documents")
    q = Q.backfill(d, "doc_id", "text", None, 1, None, NOW)
    m = F.pmod("pk", F.lit(4))
    return q.withColumn("status", F.when(m == 0, "pending").when(m == 1, "processing").when(m == 2, "done").otherwise("failed")) \
        .withColumn("updated_at", F.lit(NOW) - F.col("pk") * 60).withColumn("error", F.when(m == 3, F.concat(F.lit("e"), "pk")))


def queue_backfill(spark: SparkSession, folder: str) -> DataFrame:
    return Q.backfill(table(spark, folder, "documents"), "doc_id", "text", None, 1, None, NOW).select("vectorizer_id", "pk", "status")


def queue_claim_oldest(spark: SparkSession, folder: str) -> DataFrame:
    registry = spark.createDataFrame([(1, "documents", True)], "vectorizer_id int, name string, enabled boolean")
    return Q.claim_oldest(Q.reclaim_stale(_queue(spark, folder), NOW), registry, 85, NOW).select("pk", "status")


def queue_retention(spark: SparkSession, folder: str) -> DataFrame:
    return Q.retain(_queue(spark, folder), NOW).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def queue_status_view(spark: SparkSession, folder: str) -> DataFrame:
    registry = spark.createDataFrame([(1, "documents", True), (2, "empty", False)], "vectorizer_id int, name string, enabled boolean")
    return Q.status_view(_queue(spark, folder), registry).drop("enabled")


def queue_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """One round of the queue over the documents, by the stand-in embedder."""
    s = Session(spark)
    v = Q.Vectorizer(spark, s.embedder)
    d = table(spark, folder, "documents").select("doc_id", "text", F.lit(None).cast("array<float>").alias("emb"))
    v.create(d, "documents", "doc_id", "text", "emb", NOW)
    return v.process_queue(NOW)[1].select("pk", F.size("embedding").alias("dims"))


def queue_vanished(spark: SparkSession, folder: str) -> DataFrame:
    """One round of the queue after the documents without a language were deleted: their keys fail."""
    d = table(spark, folder, "documents").select("doc_id", "text", "lang", F.lit(None).cast("array<float>").alias("emb"))
    v = Q.Vectorizer(spark, Session(spark).embedder)
    v.create(d, "documents", "doc_id", "text", "emb", NOW)
    v.registry[1]["source"] = d.where("lang IS NOT NULL")
    v.process_queue(NOW)
    return v.queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_QUEUE_SQL = f"""WITH q AS (SELECT 1 AS vectorizer_id, doc_id AS pk, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
  {NOW} - doc_id * 60 AS updated_at, CASE WHEN doc_id % 4 = 3 THEN 'e' || doc_id END AS error FROM documents WHERE text IS NOT NULL)"""

# ---- session and agents

def diversify_dq(spark: SparkSession, folder: str) -> DataFrame:
    s, e = Session(spark), embeddings(spark, folder)
    r = A.feedback_audit(s, e, "vec_id", "embedding", e, "embedding", 5, 3, "vec_id")
    return _one(spark, {"diversity_quotient": r["diversity_quotient"]})


def feedback_penalty(spark: SparkSession, folder: str) -> DataFrame:
    s, e = Session(spark), embeddings(spark, folder)
    s.diversify_enable()
    s.isolate(e, "vec_id", "embedding", 0)
    return s.search(e, "vec_id", "embedding", query_vector(spark, folder), 10).select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


def _market(spark: SparkSession, folder: str) -> tuple[list[float], list[float]]:
    from lumenfold.plans.series_queries import market

    m = market(spark, folder).head()
    return list(m["mu"]), list(m["cov"])


def _signup_series(spark: SparkSession, folder: str) -> list[float]:
    return A._series(hourly(spark, folder).where("event_type = 'signup'"), "hour", "cents")


def _agent(name: str, run) -> None:
    QUERIES["agent_" + name] = lambda spark, folder: run(Session(spark), spark, folder, embeddings(spark, folder))


def _without(row: dict, *keys: str) -> dict:
    return {k: v for k, v in row.items() if k not in keys}


QUERIES: dict = {}
for _f in (ledger_chain, ledger_verify_ok, ledger_verify_tampered, ledger_verify_gap, ledger_latest_per_kind, queue_backfill, queue_claim_oldest, queue_retention, queue_status_view, queue_embedded, queue_vanished, ledger_hmac, ledger_reset, diversify_dq, feedback_penalty):
    QUERIES[_f.__name__] = _f

_agent("anomaly_triage", lambda s, spark, d, e: _one(spark, _without(A.anomaly_triage(s, hourly(spark, d), "cents", "hour", "event_type", "error", 128), "triage_summary")))
_agent("allocate", lambda s, spark, d, e: _one(spark, {"sharpe": A.allocate(s, *_market(spark, d), 2)["sharpe"]}))
_agent("route_task", lambda s, spark, d, e: _one(spark, _without(A.route_task(s, e, "vec_id", "embedding", query_vector(spark, d, 3), 1000.0), "rationale")))
_agent("outlier_intercept", lambda s, spark, d, e: _one(spark, _without(A.outlier_intercept(s, e, "vec_id", "embedding", query_vector(spark, d, 4), 0.1, "l2"), "reason")))
_agent("recall_hybrid", lambda s, spark, d, e: A.recall_hybrid(e, "vec_id", "embedding", query_vector(spark, d), "label", "label", 3, 5))
_agent("recommend_diverse", lambda s, spark, d, e: _second_page(s, spark, d, e).select("item_id", (F.round("score", 6) + 0.0).alias("score")))
_agent("plan_explore", lambda s, spark, d, e: A.plan_explore(e, "vec_id", "embedding", query_vector(spark, d), 8).select("branch_id", "plan", F.round("confidence_score", 6).alias("confidence_score")))
_agent("trajectory_predict", lambda s, spark, d, e: _one(spark, _without(A.trajectory_predict(s, e, "vec_id", "embedding", 0), "predicted_state_vector")))
_agent("detect_loop", lambda s, spark, d, e: _one(spark, A.detect_loop(e, "vec_id", "embedding", "all")))
_agent("data_analyst", lambda s, spark, d, e: _analyst(spark, d))
_agent("deterioration_triage", lambda s, spark, d, e: _one(spark, _without(A.deterioration_triage(s, e, "vec_id", "embedding", query_vector(spark, d), query_vector(spark, d, 1), query_vector(spark, d, 2), e.where("label = 3").select("vec_id")), "rationale")))
_agent("feedback_audit", lambda s, spark, d, e: diversify_dq(spark, d))
_agent("schedule_workload", lambda s, spark, d, e: _one(spark, {"assigned_node": A.schedule_workload(s, e, "vec_id", "embedding", query_vector(spark, d, 5))["assigned_node"]}))
_agent("rebalance_sibling", lambda s, spark, d, e: _one(spark, _rebalance(s, spark, d)))
_agent("detour_classify", lambda s, spark, d, e: _one(spark, _without(A.detour_classify(s, e, "vec_id", "embedding", query_vector(spark, d, 0), query_vector(spark, d, 1), _trace(spark, d)), "rationale")))
_agent("track_anomaly", lambda s, spark, d, e: _one(spark, _without(A.track_anomaly(s, e, "vec_id", "embedding", query_vector(spark, d, 0), query_vector(spark, d, 1), _signup_series(spark, d)), "rationale")))
_agent("network_coverage_alert", lambda s, spark, d, e: _one(spark, _without(A.coverage_alert(s, _trace(spark, d), _signup_series(spark, d)), "rationale")))
_agent("regime_triage", lambda s, spark, d, e: _one(spark, _without(A.regime_triage(s, _signup_series(spark, d)), "rationale")))
_agent("diverse_portfolios", lambda s, spark, d, e: spark.createDataFrame([(r["candidate_id"], round(r["sharpe"], 6)) for r in A.diverse_portfolios(s, *_market(spark, d), 2, 16, 0.34, 0.5, 1)], "candidate_id int, sharpe double"))
_agent("search", lambda s, spark, d, e: spark.createDataFrame([(int(x),) for x in A.search_agent(s, "which cells are typical", e, "vec_id", "embedding")["source_doc_ids"]], "vec_id bigint"))
_agent("rag_filtered", lambda s, spark, d, e: A.retrieve(s, "which cells are typical", A.filtered(e, {"label": [3, 5]}), "vec_id", "embedding", 20).groupBy("label").agg(F.count(F.lit(1)).alias("n")))
_agent("rag", lambda s, spark, d, e: _one(spark, A.rag_agent(s, "which cells are typical", e, "vec_id", "embedding")))


def _second_page(s: Session, spark: SparkSession, folder: str, e: DataFrame) -> DataFrame:
    """What is recommended when the same is asked again: away from the rows shown first."""
    q = query_vector(spark, folder)
    A.recommend_diverse(s, e, "vec_id", "embedding", q)
    return A.recommend_diverse(s, e, "vec_id", "embedding", q)


def _trace(spark: SparkSession, folder: str) -> list[float]:
    from lumenfold.plans.series_queries import _points

    return list(_points(spark, folder).where("event_type = 'signup'").head().xy)


def _rebalance(s: Session, spark: SparkSession, folder: str) -> dict:
    mu, cov = _market(spark, folder)
    n = len(mu)
    e = embeddings(spark, folder).select("vec_id", F.slice("embedding", 1, n).alias("embedding"))
    return _without(A.rebalance_sibling(s, mu, cov, 2, e, "vec_id", "embedding", query_vector(spark, folder)[:n]), "rationale", "weights")


def _analyst(spark: SparkSession, folder: str) -> DataFrame:
    """A question answered by a reasoner that drafts a bad statement first."""
    views(spark, folder)
    drafts = iter(["DROP TABLE nation", "```sql\nSELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey\n```"])
    s = Session(spark, reasoner=lambda p: next(drafts, "summary"))
    r = T.sql_agent(s, "nations per region", ["nation"], 2, True)
    return r.result


def schema_context(spark: SparkSession, folder: str) -> DataFrame:
    views(spark, folder)
    return spark.createDataFrame([(x,) for x in T.schema_context(spark, ["nation", "orders", "region"]).splitlines()], "line string")


T2S_CASES = ("SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "(SELECT n_name FROM nation)", "DROP TABLE nation", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "INSERT INTO nation VALUES (1)",
             "SELECT nope FROM nation", "UPDATE nation SET n_name = 'x'", "CREATE TABLE t AS SELECT 1", "SELEC 1", "SET x = 1", "SELECT count(*) FROM no_such_table")


def t2s_validator_matrix(spark: SparkSession, folder: str) -> DataFrame:
    views(spark, folder)
    return spark.createDataFrame([(q, T.validate(spark, q) is None) for q in T2S_CASES], "sql string, accepted boolean")


# ---- streams

def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream, in event order, from files of the shared folder."""
    path = f"{shared_dir(spark)}/lumenfold/events-{uuid.uuid4().hex}"
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return E.read_stream(spark, path, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", 4)


def _name() -> str:
    return "s_" + uuid.uuid4().hex


def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return E.run_to_table(spark, E.tumbling_counts(_event_stream(spark, folder), "ts", "event_type", late="40 days"), _name(), "complete").select(F.unix_seconds("start").alias("start"), "event_type", "n")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return E.run_to_table(spark, E.sessions(_event_stream(spark, folder), "ts", "user_id", late="40 days"), _name(), "complete").select("user_id", F.unix_micros("start").alias("start_us"), "n")


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return E.run_to_table(spark, E.sliding_means(_event_stream(spark, folder).withColumn("cents", F.round(F.col("value") * 100).cast("bigint")), "ts", "cents", late="40 days"), _name(), "complete").select(F.unix_seconds("start").alias("start"), F.round("mean", 4).alias("mean"))


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    s = _event_stream(spark, folder)
    return E.run_to_table(spark, E.without_duplicates(s.unionByName(s), "event_id", "ts", "40 days"), _name()).select("event_id", "event_type")


def stream_cycle_state(spark: SparkSession, folder: str) -> DataFrame:
    s = _event_stream(spark, folder).select("event_type", "event_id", F.substring(F.sha2(F.pmod("event_id", F.lit(3)).cast("string"), 256), 1, 4).alias("state"))
    return E.run_to_table(spark, E.cycles(s, "event_type", "event_id", "state"), _name())


for _f in (schema_context, t2s_validator_matrix, stream_tumbling, stream_sessions, stream_sliding, stream_dedup, stream_cycle_state):
    QUERIES[_f.__name__] = _f

_HASH = """WITH RECURSIVE n AS (SELECT c_nationkey AS kind, c_custkey AS id, c_name AS payload, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
c AS (SELECT kind, k, id, payload, sha256(unhex(repeat('00', 32)) || encode(payload)) AS entry_hash FROM n WHERE k = 1
  UNION ALL SELECT n.kind, n.k, n.id, n.payload, sha256(unhex(c.entry_hash) || encode(n.payload)) FROM c JOIN n ON n.kind = c.kind AND n.k = c.k + 1)"""
_PAD = {x: bytes(b ^ x for b in b"k1".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)}
_REP = WITH_Q + f""", s AS (SELECT embedding::DOUBLE[] AS s FROM embeddings WHERE vec_id = 0),
  d AS (SELECT vec_id, {COS} + 0.5 * exp(-list_sum(list_transform(list_zip(e, s), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / 0.18) AS d FROM e, s)
  SELECT vec_id, round(d, 6) + 0.0 AS distance FROM d ORDER BY d.d, vec_id LIMIT 10"""


def _near(id: int, distance: str = COS) -> str:
    return WITH_Q.replace("vec_id = 0", f"vec_id = {id}") + f", r AS (SELECT vec_id, {distance} AS d FROM e ORDER BY d, vec_id LIMIT 1)"


SQL = {
    "ledger_chain": _HASH + " SELECT id, payload, entry_hash FROM c",
    "ledger_verify_ok": "SELECT true AS ok, count(*) AS rows_verified, CAST(NULL AS BIGINT) AS first_failure_id, CAST(NULL AS VARCHAR) AS reason FROM customer",
    "ledger_verify_tampered": "SELECT false AS ok, count(*) AS rows_verified, 7::BIGINT AS first_failure_id, 'hash mismatch' AS reason FROM customer",
    "ledger_verify_gap": """SELECT false AS ok, count(*) - 1 AS rows_verified, min(c_custkey) FILTER (WHERE c_custkey > 7 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)) AS first_failure_id,
      'broken link' AS reason FROM customer""",
    "ledger_latest_per_kind": "SELECT c_nationkey AS kind, max(c_custkey) AS id, max_by(c_name, c_custkey) AS payload FROM customer GROUP BY c_nationkey",
    "ledger_hmac": f"SELECT c_custkey, sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}') || encode(c_name)))) AS mac FROM customer",
    "ledger_reset": "SELECT * FROM (VALUES ('flushed', 3, 1, true), ('compacted', 2, 1, true), ('soft', 2, 0, true), ('hard', 0, 0, true)) t(step, truth, shadow, ok)",
    "queue_embedded": "SELECT doc_id AS pk, 64 AS dims FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 85",
    "queue_vanished": """SELECT CASE WHEN n > 85 THEN 'pending' WHEN lang IS NULL THEN 'failed' ELSE 'done' END AS status, count(*) AS n
      FROM (SELECT lang, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
    "queue_backfill": "SELECT 1 AS vectorizer_id, doc_id AS pk, 'pending' AS status FROM documents WHERE text IS NOT NULL",
    "queue_claim_oldest": _QUEUE_SQL + f" SELECT pk, 'processing' AS status FROM q WHERE status = 'pending' OR (status = 'processing' AND {NOW} - updated_at > 600) ORDER BY updated_at, pk LIMIT 85",
    "queue_retention": _QUEUE_SQL + f" SELECT status, count(*) AS n FROM q WHERE NOT ((status = 'done' AND {NOW} - updated_at > 3600) OR (status = 'failed' AND {NOW} - updated_at > 86400)) GROUP BY status",
    "queue_status_view": _QUEUE_SQL + """ SELECT 1 AS vectorizer_id, 'documents' AS name, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
      count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, max(updated_at) FILTER (WHERE status = 'failed') AS last_error_at,
      max_by(error, updated_at) FILTER (WHERE status = 'failed') AS last_error FROM q UNION ALL SELECT 2, 'empty', 0, 0, 0, 0, NULL, NULL""",
    "feedback_penalty": _REP,
    "agent_recall_hybrid": WITH_Q + f"SELECT vec_id AS mem_id, label AS content FROM (SELECT vec_id, label, {COS} AS d FROM e WHERE label = 3) ORDER BY d, vec_id LIMIT 5",
    "agent_recommend_diverse": WITH_Q + f""", d AS (SELECT vec_id, e, {COS} AS d FROM e), s AS (SELECT e AS s FROM d ORDER BY d, vec_id LIMIT 10),
      p AS (SELECT d.vec_id, any_value(d.d) + 0.5 * sum(exp(-list_sum(list_transform(list_zip(d.e, s.s), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / 0.18)) AS d FROM d, s GROUP BY d.vec_id)
      SELECT vec_id AS item_id, round(1 - d, 6) + 0.0 AS score FROM p ORDER BY d, vec_id LIMIT 10""",
    "agent_plan_explore": mmr_sql(8, 0.5, "rank - 1 AS branch_id, vec_id AS plan, round(relevance, 6) AS confidence_score"),
    "agent_route_task": _near(3) + " SELECT vec_id AS routed_to, round(1 / (1 + d), 6) AS confidence, 850.0::DOUBLE AS remaining_budget FROM r",
    "agent_schedule_workload": _near(5) + " SELECT vec_id AS assigned_node FROM r",
    "agent_data_analyst": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey",
    "stream_tumbling": "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_dedup": "SELECT event_id, event_type FROM events",
}
SQL["stream_sessions"] = RELATIONAL_SQL["session_users"]


def _toward(a: str, b: str) -> str:
    """The nearest row (vec_id, d) to the direction from row a to row b, as a subquery."""
    return f"""(WITH q AS (SELECT list_transform(list_zip(y.embedding::DOUBLE[], x.embedding::DOUBLE[]), lambda z: z[1] - z[2]) AS q FROM embeddings x, embeddings y WHERE x.vec_id = {a} AND y.vec_id = {b}),
      e AS (SELECT vec_id, embedding::DOUBLE[] AS e, q FROM embeddings, q) SELECT vec_id, {COS} AS d FROM e ORDER BY d, vec_id LIMIT 1)"""


_DIM = f"(SELECT dimension FROM ({SERIES_SQL['boxcount_by_event_type']}) WHERE event_type = 'signup')"
_LAC = f"(SELECT lacunarity FROM ({SERIES_SQL['lacunarity']}) WHERE event_type = 'signup')"
_FIVE = """SELECT round(1 - avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) AS diversity_quotient
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 5) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 5) b ON a.vec_id < b.vec_id"""
SQL |= {
    "diversify_dq": _FIVE, "agent_feedback_audit": _FIVE,
    "agent_outlier_intercept": _near(4, L2) + " SELECT d < 0.1 AS intercepted, vec_id AS nearest_id, 'l2' AS metric, round(d, 6) AS distance FROM r",
    "agent_trajectory_predict": f"""SELECT (SELECT max(vec_id) FROM embeddings) AS latest_id, vec_id AS predicted_id, round(d, 6) AS projected_drift_delta, d > 0.5 AS risk_threshold_exceeded
      FROM {_toward('0', '(SELECT max(vec_id) FROM embeddings)')}""",
    "agent_anomaly_triage": f"""SELECT 'vector_drift' AS anomaly_type, round(baseline_alpha, 6) AS baseline_alpha, round(recent_alpha, 6) AS recent_alpha, round(recent_alpha - baseline_alpha, 6) AS drift,
      round(abs(recent_alpha - baseline_alpha), 6) AS threat_score FROM ({drift_sql(128, 'error')})""",
    "agent_regime_triage": f"""SELECT round(alpha, 6) AS dfa_exponent, abs(recent_alpha - baseline_alpha) > 0.5 AS drift_detected, round(recent_alpha, 6) AS recent_alpha, round(baseline_alpha, 6) AS baseline_alpha
      FROM ({drift_sql(64, 'signup')})""",
    "agent_track_anomaly": f"SELECT n.vec_id AS nearest_id, round(n.d, 6) AS trajectory_distance, round(a.alpha, 6) AS dfa_exponent FROM {_toward('0', '1')} n, ({drift_sql(64, 'signup')}) a",
    "agent_detour_classify": f"SELECT vec_id AS nearest_fleet_id, round(d, 6) AS trajectory_distance, {_DIM} AS trace_complexity FROM {_toward('0', '1')}",
    "agent_network_coverage_alert": f"SELECT {_DIM} AS morph_dimension, {_LAC} AS lacunarity, abs(recent_alpha - baseline_alpha) > 0.5 AS drift_detected FROM ({drift_sql(48, 'signup')})",
    "t2s_validator_matrix": "SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(q.replace("'", "''"), str(k < 3).lower()) for k, q in enumerate(T2S_CASES)) + ") t(sql, accepted)",
    "stream_sliding": RELATIONAL_SQL["sliding_avg"],
}
SQL |= {
    "agent_allocate": BEST_PAIR_SQL,
    "stream_cycle_state": brent_sql("SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, event_id % 3 AS st, event_id FROM events", True)
    + " SELECT r.key, event_id AS ord, hit AS cycle_len FROM r JOIN st USING (key, i) WHERE hit > 0",
    "schema_context": """SELECT * FROM (VALUES ('nation(n_nationkey int, n_name string, n_regionkey int)'),
      ('orders(o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string)'), ('region(r_regionkey int, r_name string)')) t(line)""",
}
