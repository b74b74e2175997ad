"""Ledger, queue, session, agents, text to SQL, streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import agents as A
from lumenfold.operators import ledger as L
from lumenfold.operators import text_to_sql as T
from lumenfold.session import Session
from lumenfold.streaming import events as E
from lumenfold.streaming import queue as Q

NOW = 1_000_000


def test_ledger_appends_and_verifies(spark, tmp_path):
    g = L.Ledger(spark, str(tmp_path / "ledger"), key=b"k", actor="ann")
    g.audit_log("search", '{"q": 1, "pin": 7}', redact=("pin",))
    g.audit_log("search", "[]")
    g.report(3, "positive")
    g.report(4, "negative")
    assert g.flush() == 2 and g.verify()["ok"] and g.verify()["rows_verified"] == 4
    assert json.loads(g.rows().where("id = 1").head().payload) == {"type": "search", "payload": {"q": 1, "pin": "***"}, "_actor": "ann"}
    h = L.Ledger(spark, g.path, key=b"k")
    h.load()
    assert h.truth == [{"epoch": 1, "doc_id": 3, "signal": "positive"}] and len(h.shadow) == 1
    for bad in ('{"_actor": 1}', "no json"):
        with pytest.raises(ValueError):
            g.audit_log("x", bad)
    g.reset_soft()
    assert not g.shadow and g.truth
    g.lock_destructive()
    with pytest.raises(PermissionError):
        g.reset_hard()


def test_ledger_finds_tampering(spark):
    rows = spark.createDataFrame(L.chain([f"p{k}" for k in range(9)], 2, key=b"k"), L.SCHEMA)
    assert L.verify(rows, key=b"k").head().ok
    assert not L.verify(rows, key=b"other").head().ok
    changed = L.verify(rows.withColumn("payload", F.when(F.col("id") == 5, "x").otherwise(F.col("payload")))).head()
    assert (changed.ok, changed.first_failure_id, changed.reason) == (False, 5, "hash mismatch")
    assert L.verify(rows.where("id <> 4")).head().reason == "broken link"
    assert L.verify(rows.where("id < 8"), watermark=9).head().reason == "rows are gone"
    assert L.verify(rows.limit(0)).head().ok


def test_queue_round(spark):
    docs = spark.createDataFrame([(1, "one", None), (2, None, None), (3, "three", [1.0]), (4, "boom", None)], "id bigint, text string, emb array<float>")

    def embed(text):
        if text == "boom":
            raise ValueError("cannot")
        return [float(len(text))]

    v = Q.Vectorizer(spark, embed)
    k = v.create(docs, "docs", "id", "text", "emb", NOW, cap=1)
    assert {r.pk for r in v.queue.collect()} == {1, 4}
    with pytest.raises(ValueError):
        v.create(docs, "docs", "id", "text", "emb", NOW)
    n, done = v.process_queue(NOW)
    assert n == 1 and [(r.pk, list(r.embedding)) for r in done.collect()] == [(1, [3.0])]
    assert {r.pk: r.status for r in v.queue.collect()} == {1: "done", 4: "pending"}
    v.pause(k)
    assert v.process_queue(NOW + 4000)[0] == 0
    v.resume(k)
    assert v.process_queue(NOW + 4000)[0] == 0
    view = Q.status_view(v.queue, v.registry_frame()).head()
    assert view.failed == 1 and view.last_error == "cannot" and view.pending == 0
    v.enqueue(k, docs.where("id = 3"), NOW + 4001)
    v.enqueue(k, docs.where("id = 3"), NOW + 4001)
    assert v.queue.where("status = 'pending'").count() == 1
    v.drop(k)
    assert v.queue.count() == 0
    with pytest.raises(KeyError):
        v.pause(k)


def test_queue_states():
    assert Q.rate_allowed(5, 0, 3600, 6) == (1, 0) and Q.rate_allowed(6, 0, 3601, 6) == (6, 3601) and Q.rate_allowed(0, 0, 0, None)[0] > 1 << 30


def test_stale_claims_come_back(spark):
    q = spark.createDataFrame([(1, 1, "processing", NOW - 700, None), (1, 2, "processing", NOW - 10, None), (1, 3, "done", NOW - 3700, None), (1, 4, "failed", NOW - 3700, "e")], Q.QUEUE)
    assert {r.pk: r.status for r in Q.reclaim_stale(q, NOW).collect()}[1] == "pending"
    assert {r.pk for r in Q.retain(q, NOW).collect()} == {1, 2, 4}


@pytest.fixture(scope="module")
def cards(spark):
    rows = [(k, [1.0 if j == k % 5 else 0.01 * k for j in range(5)], "a" if k % 2 else "b", f"card {k}") for k in range(20)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, kind string, text string").cache()


def test_session_settings(spark, tmp_path):
    s = Session(spark, ledger=L.Ledger(spark, str(tmp_path / "l")))
    s.config_set("mmr_lambda", 0.2)
    assert s.config_get("mmr_lambda") == 0.2 and s.config_get("diffusion") == 2
    with pytest.raises(ValueError):
        s.config_set("diffusion", 33)
    with pytest.raises(KeyError):
        s.config_get("nope")
    assert len(s.embed("some words")) == 64 and s.embed("some words") == s.embed("some words")


def test_diversified_search(spark, cards, tmp_path):
    s = Session(spark, ledger=L.Ledger(spark, str(tmp_path / "l")))
    q = [1.0, 0, 0, 0, 0]
    assert s.current_dq() is None
    s.diversify_enable()
    first = s.search(cards, "id", "v", q, 1).head().id
    assert s.current_dq() is None
    s.isolate(cards, "id", "v", first)
    s.diversify_set_params(weight=5.0)
    assert s.search(cards, "id", "v", q, 1).head().id != first
    assert s.current_dq() == pytest.approx(0) and s.overhead_p99_us() > 0 and len(s.ledger.shadow) == 1
    with pytest.raises(ValueError):
        s.diversify_set_params(window=33)


def test_agents(spark, cards, tmp_path):
    s = Session(spark, ledger=L.Ledger(spark, str(tmp_path / "l")))
    q = [0.0, 1.0, 0, 0, 0]
    recalled = A.recall_hybrid(cards, "id", "v", q, "text", "kind", "a", 3).collect()
    assert len(recalled) == 3 and all(r.mem_id % 2 == 1 for r in recalled)
    assert A.outlier_intercept(s, cards, "id", "v", q, 0.5)["intercepted"]
    assert A.route_task(s, cards, "id", "v", q, 500)["remaining_budget"] == 350
    assert A.deterioration_triage(s, cards, "id", "v", q, [0.0] * 5, q, cards.where("id < 6").select("id"), 2)["nearest_cohort_id"] < 6
    assert A.plan_explore(cards, "id", "v", q, 4).count() == 4
    assert A.detect_loop(cards, "id", "v", "bot")["is_loop_detected"] in (True, False)
    assert A.search_agent(Session(spark, embedder=lambda t: q, ledger=s.ledger), "what", cards, "id", "v", 4)["answer"]
    silent = Session(spark, reasoner=None, ledger=s.ledger)
    with pytest.raises(RuntimeError):
        A.route_task(silent, cards, "id", "v", q, 500)
    silent.config_set("agent_partial_reasoning_fail", True)
    assert A.route_task(silent, cards, "id", "v", q, 500)["reasoning_step_failed"]


def test_text_to_sql(spark, cards):
    cards.createOrReplaceTempView("cards")
    for good in ("SELECT id FROM cards", "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "VALUES (1)"):
        assert T.validate(spark, good) is None
    for bad in ("DROP TABLE cards", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "SELECT nope FROM cards", "INSERT INTO cards VALUES (1)", "", "DELETE FROM cards"):
        assert T.validate(spark, bad)
    assert T.extract_sql("Here:\n```sql\nSELECT 1;\n```") == "SELECT 1"
    assert T.schema_context(spark, ["cards"]).startswith("cards(id bigint, v array<double>")
    with pytest.raises(ValueError):
        T.schema_context(spark, ["a; b"])
    drafts = iter(["DROP TABLE cards", "SELECT count(*) AS n FROM cards"])
    r = T.sql_agent(Session(spark, reasoner=lambda p: next(drafts)), "how many", ["cards"], 2, True)
    assert r.retry_count == 1 and r.execution_status == "executed" and r.result.head().n == 20


def test_streams(spark, tmp_path):
    rows = [(k, f"k{k % 2}", bytes([k // 2 % 3]), datetime(2024, 1, 1, k % 24)) for k in range(24)]
    df = spark.createDataFrame(rows, "id bigint, key string, state binary, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.read_stream(spark, str(tmp_path / "in"), "id bigint, key string, state binary, ts timestamp")
    found = E.run_to_table(spark, E.cycles(stream, "key", "id", "state"), "t_cycles").collect()
    assert {r.cycle_len for r in found} == {3} and {r.key for r in found} == {"k0", "k1"}
    assert E.run_to_table(spark, E.without_duplicates(stream.unionByName(stream), "id", "ts", "2 days"), "t_dedup").count() == 24
    assert E.run_to_table(spark, E.tumbling_counts(stream, "ts", "key", late="2 days"), "t_tumble", "complete").count() == 24
    E.run_to_files(stream.select("id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    E.run_to_files(stream.select("id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24
    Q.embed_stream(stream.select("id", F.col("key").alias("text"), "ts"), "id", "text", lambda t: [1.0], str(tmp_path / "emb"), str(tmp_path / "cp2"), "ts", "2 days").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "emb")).count() == 24


def test_streams_keep_their_rows_out_of_the_driver(spark, tmp_path):
    rows = [(k, k % 5, datetime(2024, 1, 1 + k // 20, k % 20)) for k in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "id bigint, user bigint, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "none").mkdir()
    stream, none = (E.read_stream(spark, str(tmp_path / x), "id bigint, user bigint, ts timestamp") for x in ("in", "none"))
    # three batches: of complete ones the last counts, of appended ones all
    found = E.run_to_table(spark, E.sessions(stream, "ts", "user", "6 hours", "9 days"), "t_sessions", "complete")
    assert sorted((r.user, r.start, r.n) for r in found.collect()) == sorted((u, datetime(2024, 1, d, u), 4) for u in range(5) for d in (1, 2, 3))
    every = E.run_to_table(spark, stream.select("id", "ts"), "t_every")
    assert sorted(r.id for r in every.collect()) == list(range(60)) == sorted(r.id for r in spark.table("t_every").collect())
    apart = E.run_to_table(spark, E.sessions(stream, "ts", "user", "5 hours", "9 days"), "t_apart", "complete")
    assert apart.count() == 60  # rows exactly the gap apart are two sessions, as in SQL
    assert found.inputFiles() and len(every.inputFiles()) >= 3
    empty = E.run_to_table(spark, E.sessions(none, "ts", "user"), "t_none", "complete")
    assert empty.columns == ["user", "start", "n"] and empty.count() == 0


def test_statements_that_write_need_the_setting_and_review_can_reject(spark, small):
    from lumenfold.operators import text_to_sql as T
    from lumenfold.plans.relational import views
    from lumenfold.session import Session

    views(spark, small)
    assert T.validate(spark, "INSERT INTO nation VALUES (1)") == "not a query"
    assert T.validate(spark, "INSERT INTO nation VALUES (1)", "select_insert_update") is None
    assert T.validate(spark, "UPDATE nation SET n_name = 'x'", "select_insert_update") is None
    assert T.validate(spark, "DELETE FROM nation", "select_insert_update") == "not a query"
    said = iter(["SELECT n_name FROM nation", "it lacks the key", "SELECT n_nationkey FROM nation", "OK"])
    s = Session(spark, reasoner=lambda p: next(said))
    s.config_set("text_to_sql_use_review", True)
    r = T.text_to_sql(s, "keys of nations", ["nation"])
    assert r.generated_sql == "SELECT n_nationkey FROM nation" and r.retry_count == 1
    for key, bad in (("text_to_sql_allowed_statements", "drop"), ("http_num_ctx", -1), ("reasoning_plugin", "/a/../b")):
        with pytest.raises(ValueError):
            s.config_set(key, bad)
    s.config_set("http_url", "http://localhost:1/x")
    s.use_http()
    with pytest.raises(ValueError):
        s.reason("no plaintext")


def test_resets_and_vanished_rows(spark, tmp_path):
    g = L.Ledger(spark, str(tmp_path / "l"), key=b"k")
    g.report(1, "positive")
    g.report(2, "negative")
    g.flush()
    g.reset_hard()
    h = L.Ledger(spark, g.path, key=b"k")
    h.load()
    assert h.truth == [] and h.shadow == [] and h.verify()["ok"]
    first, second = L.Ledger(spark, g.path, key=b"k"), L.Ledger(spark, g.path, key=b"k")
    stale = second.rows()
    second.rows = lambda: stale.limit(4)  # as read before the other writer came
    last = stale.count()
    first.append(["a"], L.AUDIT)
    second.rows = lambda: stale.where(F.col("id") <= last)
    with pytest.raises(RuntimeError):
        second.append(["b"], L.AUDIT)


def test_shown_rows_are_kept_away_from(spark):
    from lumenfold.session import Session

    df = spark.createDataFrame([(k, [1.0, k / 100]) for k in range(50)] + [(99, [0.8, 0.6])], "id bigint, v array<double>")
    s = Session(spark)
    s.diversify_enable()
    first = [r.id for r in s.search(df, "id", "v", [1.0, 0.0], 5).collect()]
    second = [r.id for r in s.search(df, "id", "v", [1.0, 0.0], 5).collect()]
    assert first == [0, 1, 2, 3, 4] and not set(first) & set(second) and s.overhead_p99_us() > 0
