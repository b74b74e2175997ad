"""A sample of the core's registered queries matches its SQL on the smallest tables; the driver compares all of them."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lumenfold.plans import registry

SAMPLE = ("agg_basic", "cube", "join_asof", "join_range", "knn_cosine", "knn_join", "dfa_by_event_type", "spectral_entropy", "vec_hamming", "vec_int8_codes", "p3_rolling", "p3_found", "ledger_chain",
          "queue_status_view", "session_users", "win_rows_frame", "boxcount_by_event_type", "simhash_bits",
          "p2_rules", "scout_mmr", "agent_recommend_diverse", "ledger_hmac", "ledger_verify_gap", "queue_vanished", "portfolio_k2", "cycle_detect", "vascular", "vec_packed_roundtrip")


def canon(df):
    def one(v):
        if isinstance(v, (list, tuple)) or getattr(v, "shape", ()):
            return str(list(v))
        if v is None or pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted(str([one(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def db(small):
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, small, db, name):
    got, want = registry.QUERIES[name](spark, small).toPandas(), db.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and set(registry.QUERIES) <= set(names) and len(registry.QUERIES) > 150
    assert entry.entry(spark).count() == 10


def test_core_does_not_import_the_llm_package():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; import lumenfold.plans.registry; sys.exit(any('lumenfold.llm' in m for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent).returncode == 0


def test_scans_are_pruned_and_filters_pushed(spark, small):
    plan = registry.QUERIES["knn_l2_top1"](spark, small)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(vec_id)" in plan
    plan = registry.QUERIES["p2_scores"](spark, small)._jdf.queryExecution().toString()
    assert "state:array" not in plan and "body:string" not in plan
