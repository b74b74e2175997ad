"""Every function by its plain name, for callers that dispatch: Api(session).call(name, ...).

Tables are given by the name of a table or view of the session; `id` names their key
column (Spark has no row ids). Row sets come back as DataFrames, single results as values.
Functions of rows (vector arithmetic, series, shapes, optimizers) are listed in ROW_NAMES:
they are called on values here and registered for SQL by `functions.udfs.register`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from lumenfold import __version__
from lumenfold.functions.udfs import ARRAY_FUNCTIONS, _int8
from lumenfold.operators import agents as A
from lumenfold.operators import search as S
from lumenfold.operators import text_to_sql as T
from lumenfold.operators.ledger import unpack
from lumenfold.session import Session
from lumenfold.streaming.queue import Vectorizer


def _f32(v) -> np.ndarray:
    if isinstance(v, str):
        v = [float(x) for x in v.strip().strip("[]").split(",")]
    return np.asarray(v, dtype=np.float32).astype(np.float64)


def _both(f: Callable) -> Callable:
    def run(a, b, *rest):
        x, y = _f32(a), _f32(b)
        if len(x) != len(y):
            raise ValueError("vector dim mismatch")
        return f(x, y, *rest)

    return run


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    n = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / n if n else 0.0


def _lp(x: np.ndarray, y: np.ndarray, p: float) -> float:
    if not p > 0:
        raise ValueError("p must be positive")
    return float((np.abs(x - y) ** p).sum() ** (1 / p))


def _hamming(a: bytes, b: bytes) -> int:
    if len(a) != len(b) or not a:
        raise ValueError("packed vectors differ in length or are empty")
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def _domain(f: Callable[[float], float], ok: Callable[[float], bool] = lambda x: True) -> Callable:
    return lambda x: None if x is None or not ok(x) else float(f(x))


ROW_NAMES: dict[str, Callable] = {
    "vector": lambda dim: [0.0] * int(dim),
    "vector_from_text": lambda t: _f32(t).tolist(),
    "vector_to_json": lambda v: "[" + ",".join(f"{x:.9g}" for x in _f32(v)) + "]",
    "vector_dims": lambda v: len(_f32(v)),
    "vector_l2_distance": _both(lambda x, y: float(np.linalg.norm(x - y))),
    "vector_l2_squared": _both(lambda x, y: float(((x - y) ** 2).sum())),
    "vector_cosine_distance": _both(lambda x, y: 1 - _cosine(x, y)),
    "vector_cosine_similarity": _both(_cosine),
    "vector_negative_inner_product": _both(lambda x, y: -float(x @ y)),
    "vector_add": _both(lambda x, y: (x + y).tolist()),
    "vector_sub": _both(lambda x, y: (x - y).tolist()),
    "vector_scale": lambda v, s: (_f32(v) * s).tolist(),
    "vector_norm": lambda v: float(np.linalg.norm(_f32(v))),
    "vector_normalize": lambda v: (_f32(v) / (np.linalg.norm(_f32(v)) or 1.0)).tolist(),
    "vector_lp_distance": _both(_lp),
    "vector_quantize_int8": lambda v: _int8(_f32(v)),
    "vector_quantize_binary": lambda v: np.packbits(_f32(v) >= 0).tobytes(),
    "vector_hamming_distance": _hamming,
    "search": _both(lambda x, y: 1 - _cosine(x, y)),
    "sin": _domain(np.sin), "cos": _domain(np.cos), "sqrt": _domain(np.sqrt, lambda x: x >= 0),
    "audit_unpack": unpack,
    **{name: f for name, (f, _) in ARRAY_FUNCTIONS.items()},
}


class Api:
    def __init__(self, session: Session, vectorizer: Vectorizer | None = None):
        self.session, self.spark = session, session.spark
        self.vectorizer = vectorizer or Vectorizer(session.spark, session.embedder)
        self.features: DataFrame | None = None
        s, g, v = session, session.ledger, self.vectorizer
        self.names: dict[str, Callable] = ROW_NAMES | {
            "version": lambda: __version__, "edition": lambda: "open",
            "search_explore": self._on(lambda t, id, col, q, k=50, lam=None: S.mmr(t, id, col, q, k, float(s.config_get("mmr_lambda") if lam is None else lam))),
            "search_telemetry": self._on(lambda t, id, col, q, k: s.search(t, id, col, q, k)),
            "hybrid_clinical_search": self._on(lambda t, id, col, q, ids, k: S.hybrid_knn(t, id, col, q, self._ids(t, id, ids), k)),
            "search_trajectory": self._on(lambda t, id, col, a, b, k: S.trajectory_knn(t, id, col, a, b, k)),
            "cross_modal_search": self._on(lambda t, id, col, m, c, alpha, k: S.cross_modal_knn(t, id, col, m, c, alpha, k)),
            "store_morphology": self._store, "mine_topology_negatives": lambda q, k: S.topology_negatives(self.features, q, k),
            "diversify_enable": s.diversify_enable, "diversify_disable": s.diversify_disable, "diversify_set_params": lambda **p: s.diversify_set_params(**p),
            "diversify_current_dq": s.current_dq, "detect_collapse": s.detect_collapse, "diversify_overhead_p99_us": s.overhead_p99_us, "explain_result": s.explain_result,
            "feedback_report": self._on(lambda t, id, col, handle, signal, ms=None: s.feedback(t, id, col, handle, signal, ms)),
            "isolate_background": self._on(lambda t, id, col, handle: s.isolate(t, id, col, handle)),
            "reason": s.reason, "embed": s.embed, "schema_context": lambda tables=None: T.schema_context(self.spark, tables),
            "text_to_sql": lambda q, tables=None: T.text_to_sql(s, q, tables).generated_sql, "sql_agent": lambda q, tables=None, retries=2, run=False: T.sql_agent(s, q, tables, retries, run),
            "search_agent": self._on(lambda t, id, col, q, k=None: A.search_agent(s, q, t, id, col, k)), "rag_agent": self._on(lambda t, id, col, q, k=None: A.rag_agent(s, q, t, id, col, k)),
            "agent_plan_explore": self._on(lambda t, id, col, state, n: A.plan_explore(t, id, col, state, n)),
            "agent_trajectory_predict": self._on(lambda t, id, col, baseline: A.trajectory_predict(s, t, id, col, baseline)),
            "agent_detect_loop": self._on(lambda t, id, col, agent, n_bits=64, seed=42, ham=0: A.detect_loop(t, id, col, agent, n_bits, seed, ham)),
            "agent_anomaly_triage": lambda table, metric, order, col, value, window=32: A.anomaly_triage(s, self.spark.table(table), metric, order, col, value, window),
            "agent_allocate": lambda mu, cov, k: A.allocate(s, mu, cov, k),
            "agent_route_task": self._on(lambda t, id, col, q, budget, cost=150: A.route_task(s, t, id, col, q, budget, cost)),
            "agent_outlier_intercept": self._on(lambda t, id, col, q, thr, metric="cosine": A.outlier_intercept(s, t, id, col, q, thr, metric)),
            "agent_recall_hybrid": self._on(lambda t, id, col, q, content, fcol=None, fval=None, k=5: A.recall_hybrid(t, id, col, q, content, fcol, fval, k)),
            "agent_recommend_diverse": self._on(lambda t, id, col, q, k=10: A.recommend_diverse(s, t, id, col, q, k)),
            "agent_data_analyst": lambda q, tables=None, retries=2, run=False: A.data_analyst(s, q, tables, retries, run),
            "agent_patient_deterioration_triage": self._on(lambda t, id, col, q, a, b, ids=None, k=5: A.deterioration_triage(s, t, id, col, q, a, b, None if ids is None else self._ids(t, id, ids), k)),
            "agent_feedback_audit": self._on(lambda t, id, col, warm, warm_col, n=8, k=3: A.feedback_audit(s, t, id, col, self.spark.table(warm), warm_col, n, k)),
            "agent_schedule_workload": self._on(lambda t, id, col, q, iters=30, pop=50: A.schedule_workload(s, t, id, col, q, iters, pop)),
            "agent_rebalance_sibling": self._on(lambda t, id, col, mu, cov, k, base: A.rebalance_sibling(s, mu, cov, k, t, id, col, base)),
            "agent_detour_classify": self._on(lambda t, id, col, a, b, gps, dim=2: A.detour_classify(s, t, id, col, a, b, gps, dim)),
            "agent_track_anomaly": self._on(lambda t, id, col, a, b, heading: A.track_anomaly(s, t, id, col, a, b, heading)),
            "agent_network_coverage_alert": lambda pts, x, dim=2, win=48, thr=0.5: A.coverage_alert(s, pts, x, dim, win, thr),
            "agent_regime_triage": lambda x, win=64, thr=0.5: A.regime_triage(s, x, win, thr),
            "agent_diverse_portfolios": lambda mu, cov, k, n=8, ov=0.15, q=0.9, seed=0, mode="sharpe": A.diverse_portfolios(s, mu, cov, k, n, ov, q, seed, mode),
            "audit_log": g.audit_log, "set_actor": g.set_actor, "lock_destructive": g.lock_destructive, "ledger_flush": g.flush, "ledger_load": g.load, "ledger_compact": g.compact,
            "ledger_reset_soft": g.reset_soft, "ledger_reset_hard": g.reset_hard, "ledger_truth_count": lambda: len(g.truth), "ledger_shadow_count": lambda: len(g.shadow), "ledger_verify": g.verify,
            "vectorizer_create": lambda table, pk, text, emb, now, cap=None: v.create(self.spark.table(table), table, pk, text, emb, now, cap),
            "vectorizer_pause": v.pause, "vectorizer_resume": v.resume, "vectorizer_drop": v.drop, "vectorizer_process_queue": v.process_queue,
            "config_set": s.config_set, "config_get": s.config_get,
        }

    def _on(self, f: Callable) -> Callable:
        return lambda table, col, *args, id="id", **kw: f(self.spark.table(table), id, col, *args, **kw)

    def _ids(self, t: DataFrame, id: str, ids) -> DataFrame:
        return ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(x,) for x in ids], f"{id} {t.schema[id].dataType.simpleString()}")

    def _store(self, doc_id: int, features: list[float], force: bool = False) -> str:
        if doc_id < 0:
            raise ValueError("doc_id must be >= 0")
        new = self.spark.createDataFrame([(doc_id, [float(x) for x in features])], "doc_id bigint, features array<double>")
        self.features = S.store_features(self.features, new, self.session.ledger.actor, force)
        return "ok"

    def call(self, name: str, *args, **kw):
        """The result of a function; null in a value argument of a row function gives None."""
        if name not in self.names:
            raise KeyError(f"no function {name}")
        if name in ROW_NAMES and any(a is None for a in args):
            return None
        return self.names[name](*args, **kw)


__all__ = ["Api", "ROW_NAMES"]
