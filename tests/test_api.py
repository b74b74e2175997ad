"""Dispatch by name."""

import pytest

from lumenfold.api import Api
from lumenfold.operators.ledger import Ledger
from lumenfold.session import Session


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    spark.createDataFrame([(k, [float(k == j) + 0.01 * k for j in range(4)], "a" if k % 2 else "b", f"t{k}", None) for k in range(12)], "id bigint, v array<double>, kind string, text string, emb array<float>").createOrReplaceTempView("cards12")
    return Api(Session(spark, ledger=Ledger(spark, str(tmp_path_factory.mktemp("l") / "ledger"))))


def test_row_functions(api):
    c = api.call
    assert c("vector_add", "1,2,3", "[1,1,1]") == [2, 3, 4] and c("vector_norm", [3, 4, 0]) == 5 and c("vector_dims", "[1,2]") == 2
    assert c("vector_hamming_distance", c("vector_quantize_binary", [1, -1]), c("vector_quantize_binary", [1, 1])) == 1
    assert c("sqrt", -1) is None and c("sqrt", 4) == 2 and c("vector_add", None, [1]) is None
    assert c("change_point_detect", [0.0] * 20 + [5.0] * 20, 5, 1.0) == [20]
    with pytest.raises(ValueError):
        c("vector_l2_distance", [1], [1, 2])
    with pytest.raises(KeyError):
        c("nope")


def test_table_functions(api):
    q = [1.0, 0, 0, 0]
    assert [r.id for r in api.call("search_telemetry", "cards12", "v", q, 1).collect()] == [0]
    assert {r.id for r in api.call("hybrid_clinical_search", "cards12", "v", q, [2, 4, 5], 3).collect()} == {2, 4, 5}
    assert api.call("search_explore", "cards12", "v", q, 6).count() == 6
    assert api.call("agent_recall_hybrid", "cards12", "v", q, "text", "kind", "a", 2).count() == 2
    api.call("store_morphology", 1, [0.0, 1.0])
    api.call("store_morphology", 2, [5.0, 1.0])
    assert [r.doc_id for r in api.call("mine_topology_negatives", [4.0, 1.0], 1).collect()] == [2]
    api.call("feedback_report", "cards12", "v", 3, "negative")
    assert api.call("ledger_shadow_count") == 1 and api.call("ledger_truth_count") == 0
    k = api.call("vectorizer_create", "cards12", "id", "text", "emb", 1000)
    assert api.call("vectorizer_process_queue", 1000)[0] == 12
    api.call("vectorizer_drop", k)
    assert len(api.names) >= 95
