"""Searches against numpy."""

import numpy as np
import pandas as pd
import pytest

from lumenfold.operators import search as S


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(5).normal(size=(300, 6))
    return x, spark.createDataFrame(pd.DataFrame({"id": range(300), "v": x.tolist(), "g": [k % 3 for k in range(300)]})).cache()


def order(x, q):
    d = 1 - (x @ q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return np.argsort(d, kind="stable")


def test_knn_and_cohort(cloud):
    x, df = cloud
    assert [r.id for r in S.knn(df, "id", "v", x[7].tolist(), 5).collect()] == order(x, x[7])[:5].tolist()
    only = [k for k in order(x, x[7]) if k % 3 == 0][:4]
    assert [r.id for r in S.hybrid_knn(df, "id", "v", x[7].tolist(), df.where("g = 0").select("id"), 4).collect()] == only
    with pytest.raises(ValueError):
        S.knn(df, "id", "v", x[0].tolist(), 0)


def test_knn_join_blocks(cloud):
    x, df = cloud
    got = S.knn_join(df.where("id < 40"), "id", df, "id", "v", 3, block=8).collect()
    assert {(r.id, r["rank"]): r.neighbor_id for r in got} == {(k, j + 1): order(x, x[k])[j] for k in range(40) for j in range(3)}


def test_trajectory_and_cross_modal(cloud):
    x, df = cloud
    assert [r.id for r in S.trajectory_knn(df, "id", "v", x[0].tolist(), x[1].tolist(), 3).collect()] == order(x, x[1] - x[0])[:3].tolist()
    q = np.r_[0.3 * x[0][:3], 0.7 * x[1][:3]]
    assert [r.id for r in S.cross_modal_knn(df, "id", "v", x[0][:3].tolist(), x[1][:3].tolist(), 0.3, 3).collect()] == order(x, q)[:3].tolist()
    with pytest.raises(ValueError):
        S.cross_modal_knn(df, "id", "v", [1], [1], 2, 3)


def test_mmr_spreads(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 5))
    x = np.repeat(centres, 20, axis=0) + rng.normal(0, 0.01, (160, 5))
    df = spark.createDataFrame(pd.DataFrame({"id": range(160), "v": x.tolist()}))
    picks = [r.id for r in S.mmr(df, "id", "v", centres[0].tolist(), 8, 0.2).orderBy("rank").collect()]
    assert len(set(picks)) == 8 and len({p // 20 for p in picks}) >= 6
    assert len(S.mmr(df, "id", "v", centres[0].tolist(), 500, 0.5).collect()) == 160


@pytest.mark.parametrize("lam", [0.2, 0.5])
def test_mmr_chooses_among_all_rows(spark, lam):
    rng = np.random.default_rng(4)
    # a crowd around the query, and few rows elsewhere that a small pool would not hold
    x = np.vstack([np.array([1.0, 0, 0, 0, 0, 0]) + rng.normal(0, 0.05, (600, 6)), rng.normal(size=(40, 6))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist()}))
    q = [1.0, 0, 0, 0, 0, 0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rel, worst, want = u @ np.array(q), np.zeros(len(x)), []
    for _ in range(12):
        s = np.round(lam * rel - (1 - lam) * worst, 12)
        s[want] = -np.inf
        want.append(int(s.argmax()))
        worst = (u @ u[want].T).max(axis=1)
    assert [r.id for r in S.mmr(df, "id", "v", q, 12, lam, 20).orderBy("rank").collect()] == want


def test_scan_position(cloud):
    _, df = cloud
    got = S.with_scan_position(df.where("g = 1"), "id").orderBy("id").collect()
    assert [r.scan_pos for r in got] == list(range(100))


def test_vector_checks_and_feature_store(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id int, v array<double>")
    assert S.check_vectors(df, "v", 2, "skip").count() == 1
    with pytest.raises(Exception, match="malformed"):
        S.check_vectors(df, "v", 2).collect()
    a = S.store_features(None, spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id int, features array<double>"), "ann")
    b = S.store_features(a, spark.createDataFrame([(2, [5.0]), (3, [3.0])], "doc_id int, features array<double>"), "bo")
    assert {r.doc_id: r.features[0] for r in b.collect()} == {1: 1, 2: 2, 3: 3}
    c = S.store_features(a, spark.createDataFrame([(2, [5.0])], "doc_id int, features array<double>"), "bo", force=True)
    assert {r.doc_id: r.features[0] for r in c.collect()} == {1: 1, 2: 5}
    assert [r.doc_id for r in S.topology_negatives(b, [2.9], 2).collect()] == [3, 2]


def test_repulsion_moves_shown_rows_back(cloud):
    x, df = cloud
    first = S.knn(df, "id", "v", x[7].tolist(), 1).head().id
    again = S.knn(df, "id", "v", x[7].tolist(), 1, penalty=S.repulsion("v", [x[first].tolist()], 0.3, 5.0)).head().id
    assert first == 7 and again != 7


def test_search_debug_has_a_row_for_every_embedding(spark, small):
    from lumenfold.plans.vector_queries import embeddings, search_debug

    assert search_debug(spark, small).count() == embeddings(spark, small).count()
