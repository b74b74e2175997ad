"""Compositions of the operators that end in a text by a pluggable reasoner.

Every function returns a dict: the data half comes from DataFrame plans (a few rows are
collected at the end), the text from session.explain. Where reasoning fails and the setting
allows it, the data half comes back with reasoning_step_failed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import kernels as K
from lumenfold.functions.udfs import ordered_series
from lumenfold.operators import search as S
from lumenfold.operators.text_to_sql import sql_agent


def _text(session, name: str, data: dict, field: str = "rationale") -> dict:
    r = session.explain(f"{name}: explain the result", json.dumps(data, default=str, sort_keys=True))
    return data | {field: r["text"]} | ({"reasoning_step_failed": True} if r["reasoning_step_failed"] else {})


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _series(df: DataFrame, order: str, value: str) -> list[float]:
    r = ordered_series(df.withColumn("_all", F.lit(1)), ["_all"], order, value).head()
    return list(r.series) if r else []


# ---- retrieval

def retrieve(session, question: str, df: DataFrame, id: str, vec: str, k: int | None = None, lam: float | None = None) -> DataFrame:
    """Rows for a question: its embedding, a diverse choice, and the rows without their vectors."""
    hits = S.mmr(df, id, vec, session.embed(question), k or int(session.config_get("default_k")), float(session.config_get("mmr_lambda") if lam is None else lam))
    return S.fetch_rows(df, id, hits.select(id, "rank", "relevance"), [vec]).orderBy("rank").limit(int(session.config_get("max_context_rows")))


def search_agent(session, question: str, df: DataFrame, id: str, vec: str, k: int | None = None) -> dict:
    rows = _rows(retrieve(session, question, df, id, vec, k))
    return _text(session, question, {"source_doc_ids": [r[id] for r in rows], "rows": rows}, "answer")


def rag_agent(session, question: str, df: DataFrame, id: str, vec: str, k: int | None = None, where: dict | None = None) -> dict:
    """The answer from retrieved rows; `where` restricts them, before any distance, to rows whose columns have the given values (a list: any of them)."""
    return {"answer": search_agent(session, question, filtered(df, where), id, vec, k)["answer"]}


def filtered(df: DataFrame, where: dict | None) -> DataFrame:
    for c, v in (where or {}).items():
        if c not in df.columns:
            raise ValueError(f"no column {c}")
        df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return df


def recall_hybrid(df: DataFrame, id: str, vec: str, query: list[float], content: str, filter_col: str | None = None, filter_value=None, k: int = 5) -> DataFrame:
    """(mem_id, content): the nearest rows among those of one value."""
    rows = df if filter_col is None else df.where(F.col(filter_col) == F.lit(filter_value))
    hits = S.knn(rows, id, vec, query, k)
    return S.fetch_rows(rows.select(id, content), id, hits, []).orderBy("distance", id).select(F.col(id).alias("mem_id"), F.col(content).alias("content"))


def recommend_diverse(session, df: DataFrame, id: str, vec: str, query: list[float], k: int = 10) -> DataFrame:
    """(item_id, score): nearest rows away from what was shown before; turns diversifying on and leaves it on."""
    session.diversify_enable()
    return session.search(df, id, vec, query, k).select(F.col(id).alias("item_id"), (1 - F.col("distance")).alias("score"))


def plan_explore(df: DataFrame, id: str, vec: str, state: list[float], max_branches: int, lam: float = 0.5) -> DataFrame:
    """(branch_id, plan, confidence_score): diverse strategies for a state."""
    if not 1 <= max_branches <= 10000:
        raise ValueError("max_branches must be in 1..10000")
    return S.mmr(df, id, vec, state, max_branches, lam).select((F.col("rank") - 1).alias("branch_id"), F.col(id).alias("plan"), F.col("relevance").alias("confidence_score"))


def trajectory_predict(session, df: DataFrame, id: str, vec: str, baseline_id) -> dict:
    """From one row to the latest: the stored state nearest to that direction."""
    last = df.agg(F.max_by(vec, id), F.max(id)).head()
    near = S.trajectory_knn(df, id, vec, S.vector_of(df, id, vec, baseline_id), [float(x) for x in last[0]], 1).head()
    return {"latest_id": last[1], "predicted_id": near[0], "predicted_state_vector": S.vector_of(df, id, vec, near[0]), "projected_drift_delta": near.distance, "risk_threshold_exceeded": near.distance > 0.5}


def detect_loop(df: DataFrame, order: str, vec: str, agent: str, n_bits: int = 64, seed: int = 42, hamming: int = 0) -> dict:
    states = df.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, vec))), lambda s: s[vec]).alias("s")).head().s
    if not states:
        raise ValueError("no states")
    return {"agent_id": agent} | K.detect_loop([x for s in states for x in s], len(states[0]), n_bits, seed, hamming)


# ---- domain compositions

def anomaly_triage(session, df: DataFrame, metric: str, order: str, filter_col: str, value, window: int = 32) -> dict:
    d = K.dfa_drift(_series(df.where(F.col(filter_col) == F.lit(value)), order, metric), window)
    return _text(session, "anomaly triage", {"threat_score": abs(d["drift"]), "anomaly_type": "vector_drift"} | d, "triage_summary")


def allocate(session, mu: list[float], cov: list[float], cardinality: int, seed: int = 0) -> dict:
    r = K.portfolio(mu, cov, cardinality, seed)
    return _text(session, "allocation", {"allocation": r["weights"], "sharpe": r["sharpe"]})


def route_task(session, df: DataFrame, id: str, vec: str, task: list[float], budget: float, cost: float = 150) -> dict:
    near = S.knn(df, id, vec, task, 1).head()
    return _text(session, "routing", {"routed_to": near[0], "confidence": 1 / (1 + near.distance), "remaining_budget": budget - cost})


def outlier_intercept(session, df: DataFrame, id: str, vec: str, query: list[float], threshold: float, metric: str = "cosine") -> dict:
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    near = S.knn(df.where(F.col(vec).isNotNull()), id, vec, query, 1, metric).head()
    return _text(session, "intercept", {"intercepted": near.distance < threshold, "nearest_id": near[0], "metric": metric, "distance": near.distance}, "reason")


def data_analyst(session, question: str, tables: list[str] | None = None, retries: int = 2, auto_execute: bool = False) -> dict:
    r = sql_agent(session, question, tables, retries, auto_execute)
    rows = _rows(r.result) if r.result is not None else None
    return _text(session, question, {"generated_sql": r.generated_sql, "execution_status": r.execution_status, "result": rows}, "analysis")


def deterioration_triage(session, df: DataFrame, id: str, vec: str, query: list[float], baseline: list[float], current: list[float], cohort: DataFrame | None = None, k: int = 5) -> dict:
    matches = _rows(S.hybrid_knn(df, id, vec, query, cohort, k) if cohort is not None else S.knn(df, id, vec, query, k))
    if not matches:
        raise ValueError("the cohort is empty")
    drift = S.trajectory_knn(df, id, vec, baseline, current, 1).head()
    return _text(session, "deterioration triage", {"nearest_cohort_id": matches[0][id], "cohort_distance": matches[0]["distance"], "drift_distance": drift.distance, "cohort_matches": matches})


def feedback_audit(session, catalog: DataFrame, id: str, vec: str, warm: DataFrame, warm_vec: str, n: int = 8, k: int = 3, order: str | None = None) -> dict:
    """Diversity of recent queries: the first n warm-up vectors, by `order` or else by their values, are searched one after another while diversifying."""
    session.diversify_enable()
    for r in warm.orderBy(order or warm_vec).select(warm_vec).limit(n).collect():
        session.search(catalog, id, vec, [float(x) for x in r[0]], k)
    return {"diversity_quotient": session.current_dq(), "explanation": session.explain_result()}


def schedule_workload(session, df: DataFrame, id: str, vec: str, workload: list[float], iterations: int = 30, population: int = 50) -> dict:
    best = K.diffusion_search(workload, iterations, population, seed=int(session.config_get("default_seed")))["best_point"]
    near = S.knn(df, id, vec, best, 1).head()
    return _text(session, "scheduling", {"assigned_node": near[0], "confidence": 1 / (1 + near.distance)})


def rebalance_sibling(session, mu, cov, cardinality: int, df: DataFrame, id: str, vec: str, baseline: list[float], seed: int = 0) -> dict:
    r = K.portfolio(mu, cov, cardinality, seed)
    near = S.trajectory_knn(df, id, vec, baseline, r["weights"], 1).head()
    return _text(session, "rebalancing", r | {"nearest_alloc_id": near[0], "nearest_distance": near.distance})


def detour_classify(session, df: DataFrame, id: str, vec: str, baseline, current, trace: list[float], dim: int = 2) -> dict:
    near = S.trajectory_knn(df, id, vec, baseline, current, 1).head()
    return _text(session, "detour", {"nearest_fleet_id": near[0], "trajectory_distance": near.distance, "trace_complexity": K.box_dimension(trace, dim)})


def track_anomaly(session, df: DataFrame, id: str, vec: str, baseline, current, heading: list[float]) -> dict:
    near = S.trajectory_knn(df, id, vec, baseline, current, 1).head()
    return _text(session, "track", {"nearest_id": near[0], "trajectory_distance": near.distance, "dfa_exponent": K.dfa(heading)})


def coverage_alert(session, points: list[float], series: list[float], dim: int = 2, window: int = 48, threshold: float = 0.5) -> dict:
    m, d = K.morphology(points, dim), K.dfa_drift(series, window)
    return _text(session, "coverage", {"morph_dimension": m["dimension"], "lacunarity": m["lacunarity"], "drift_detected": abs(d["drift"]) > threshold})


def regime_triage(session, series: list[float], window: int = 64, threshold: float = 0.5) -> dict:
    d = K.dfa_drift(series, window)
    return _text(session, "regime", {"dfa_exponent": K.dfa(series), "drift_detected": abs(d["drift"]) > threshold, "recent_alpha": d["recent_alpha"], "baseline_alpha": d["baseline_alpha"]})


def diverse_portfolios(session, mu, cov, cardinality: int, n: int = 8, overlap: float = 0.15, quality: float = 0.9, seed: int = 0, mode: str = "sharpe") -> list[dict]:
    if mode not in ("sharpe", "pareto"):
        raise ValueError("mode must be sharpe or pareto")
    found = K.portfolios(mu, cov, cardinality, n, overlap, quality, seed) if mode == "sharpe" else K.pareto_front(mu, cov, cardinality, n, n, seed)
    return [_text(session, "portfolio", {"candidate_id": k} | r) for k, r in enumerate(found)]


#: name -> function, for dispatch by name
TOOLS = {f.__name__: f for f in (
    search_agent, rag_agent, recall_hybrid, recommend_diverse, plan_explore, trajectory_predict, detect_loop, anomaly_triage, allocate, route_task, outlier_intercept, data_analyst,
    deterioration_triage, feedback_audit, schedule_workload, rebalance_sibling, detour_classify, track_anomaly, coverage_alert, regime_triage, diverse_portfolios, sql_agent)}
