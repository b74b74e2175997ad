"""Nearest neighbours, pivot clusters and varied subsets against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from lumenfold.llm import clusters as C
from lumenfold.llm.diverse import farthest_first, varied_subset
from lumenfold.llm.graph import PrunedGraph
from lumenfold.llm.neighbors import most_similar, mutual_pairs
from lumenfold.llm.vectors import unit


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_graph_recall():
    x = np.random.default_rng(0).normal(size=(3000, 12))
    u = unit(x)
    ids, d = PrunedGraph(u).search(u[:400], 32, start=np.arange(400))
    want = exact(x, 5)
    assert np.mean([len(set(want[k]) & set(ids[k].tolist())) / 5 for k in range(400)]) > 0.95
    assert (np.diff(d, axis=1) >= 0).all()


@pytest.mark.parametrize("n", [1, 2, 40])
def test_tiny_graphs(n):
    u = unit(np.random.default_rng(1).normal(size=(n, 4)))
    ids, _ = PrunedGraph(u).search(u, min(n, 32))
    assert all(k in ids[k] for k in range(n))


@pytest.mark.parametrize("crowd", [False, True])
def test_sharded_search_recall(spark, crowd):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8))
    if crowd:
        x[:600] = x[0] + rng.normal(0, 0.01, (600, 8))
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist()}))
    got = most_similar(df, "id", "v", 8, 5, target=200, most=400).toPandas()
    want = exact(x, 5)
    found = {(int(a), int(b)) for a, b in zip(got["key"], got["neighbor"])}
    assert got.groupby("key").size().eq(5).all() and len(got) == 5 * len(x)
    assert np.mean([(k, int(j)) in found for k in range(len(x)) for j in want[k]]) > 0.93


def test_probes_grow_with_the_shards(spark):
    # about 40 shards without any structure: the 3 nearest hold well below 0.9 of the neighbours
    x = np.random.default_rng(6).normal(size=(4000, 16)).astype(np.float32).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist()}))
    got = most_similar(df, "id", "v", 16, 5, target=100, most=200).toPandas()
    want = exact(x, 5)
    found = {(int(a), int(b)) for a, b in zip(got["key"], got["neighbor"])}
    assert np.mean([(k, int(j)) in found for k in range(0, len(x), 50) for j in want[k]]) >= 0.9


def test_neighbours_edge_cases(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], None), (3, [1.0, 0.0], ""), (4, [1.0, 0.1], "y"), (5, None, "y"), (6, [nan, 1.0], "y"), (7, [0.0, 0.0], "y"), (8, [1.0], "y"), (None, [1.0, 0.0], "y"), (9, [-1.0, 0.0], "y")]
    df = spark.createDataFrame(rows, "id int, v array<double>, key string").selectExpr("*", "'q' AS vec", "1 AS shard")
    got = {(r.key, r.neighbor, r["rank"]) for r in most_similar(df, "id", "v", 2, 3).collect()}
    assert {(a, b) for a, b, _ in got if a in "123"} == {("1", "2"), ("1", "3"), ("1", "4"), ("2", "1"), ("2", "3"), ("2", "4"), ("3", "1"), ("3", "2"), ("3", "4")}
    assert ("1", "2", 1) in got and ("1", "3", 2) in got and len([g for g in got if g[0] == "9"]) == 3
    pairs = {(r.key_a, r.key_b) for r in mutual_pairs(most_similar(df, "id", "v", 2, 3, 0.95)).collect()}
    assert pairs == {("1", "2"), ("1", "3"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4")}
    assert most_similar(df.limit(0), "id", "v", 2).count() == 0


def test_many_copies_of_one_vector(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0] if k < 30 else [1.0, float(k)]) for k in range(40)], "id int, v array<double>")
    got = most_similar(df, "id", "v", 2, 5).toPandas()
    assert got.groupby("key").size().eq(5).all()
    assert set(got[got["key"] == "29"]["neighbor"]) == {"0", "1", "10", "11", "12"}


def brute_groups(p, step, least):
    n = len(p)
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= step * step
    label = list(range(n))
    for i in range(n):
        stack = [i] if label[i] == i and not any(label[j] < i and near[i, j] for j in range(i)) else []
        while stack:
            a = stack.pop()
            for b in np.flatnonzero(near[a]):
                if label[b] > i:
                    label[b] = i
                    stack.append(int(b))
    groups = {}
    for k, g in enumerate(label):
        groups.setdefault(g, []).append(k)
    return {(min(m), k) for m in groups.values() if len(m) >= least for k in m}


@pytest.mark.parametrize("seed", range(3))
def test_groups_by_chains(spark, seed):
    rng = np.random.default_rng(seed)
    walk = np.cumsum(rng.normal(0, 1.2, (150, 3)), axis=0)
    p = np.vstack([walk, rng.uniform(-60, 60, (150, 3)), rng.normal(30, 0.3, (200, 3))]).round(3)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(p)), "c": p.tolist()}))
    found = C.CellClusters(df, "id", "c")
    assert {(r.root_id, r.id) for r in found.groups().collect()} == brute_groups(p, 3.0, 5)
    m = found.members().toPandas()
    assert sorted(m["id"]) == list(range(len(p)))
    size = {r["cluster"]: (r["size"], list(r.typical)) for r in C.describe(found.members().withColumnRenamed("pivot", "cluster")).collect()}
    assert sum(s for s, _ in size.values()) == len(p)
    for cluster, (s, typical) in size.items():
        mine = m[m["pivot"] == cluster]
        q = mine[["x", "y", "z"]].to_numpy()
        assert len(typical) == min(3, s) and typical[0] in set(mine["id"])
        d = np.linalg.norm(q - q.mean(axis=0), axis=1)
        assert math.isclose(d[mine["id"].to_numpy() == typical[0]][0], d.min(), abs_tol=1e-9)


def test_undecided_cubes_are_compared_point_by_point(spark):
    # two cubes of many points each, of which only one pair is within a step
    rng = np.random.default_rng(0)
    a = rng.uniform(0.2, 0.6, (300, 3)) * [1, 1, 1]
    b = rng.uniform(0.2, 0.6, (300, 3)) + [3.47, 0, 0]
    p = np.vstack([a, b, [[0.9, 0.5, 0.5]], [[3.68, 0.5, 0.5]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(p)), "c": p.tolist()}))
    assert {(r.root_id, r.id) for r in C.CellClusters(df, "id", "c").groups().collect()} == brute_groups(p, 3.0, 5)


def test_unusable_points(spark):
    nan = float("nan")
    rows = [(k, [0.0, 0.0, float(k)]) for k in range(5)] + [(1, [0.0, 0.0, 1.0]), (10, None), (11, [1.0, 2.0]), (12, [nan, 0.0, 0.0]), (13, [0.0, 0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, c array<double>").selectExpr("*", "1 AS node", "2 AS x")
    assert {(r.root_id, r.id) for r in C.CellClusters(df, "id", "c").groups().collect()} == {(0, k) for k in range(5)}
    assert C.CellClusters(df.limit(0), "id", "c").groups().count() == 0


def test_varied_subset_covers_kinds_and_space(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.001, (2000, 4)) + 0.5, rng.uniform(0, 1, (60, 4))])
    kind = ["Crowd-one"] * 1000 + ["crowd_one"] * 1000 + [f"k{j % 6}" for j in range(60)]
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist(), "kind": kind})).selectExpr("*", "'c' AS vec", "1 AS radius")
    got = varied_subset(df, "id", "v", "kind", 4, 24).toPandas()
    assert len(got) == 24 and got["id"].is_unique and (got["id"] < 2000).sum() <= 4
    assert set(got.sort_values("rank").head(14)["kind"]) == {"crowd-one", *(f"k{j}" for j in range(6))}
    # the covering radius is within the bound of a core-set of core-sets of the greedy one
    k = np.array(["crowd-one"] * 2000 + kind[2000:])

    def cover(ids):
        return max(min(((x[i] - x[j]) ** 2).sum() + 0.25 * (k[i] != k[j]) for j in ids) for i in range(len(x))) ** 0.5

    assert cover(got["id"].tolist()) <= 2 * cover(farthest_first(x, k, 24, 0.5, 0)[0].tolist())


def test_subset_edge_cases(spark):
    rows = [(1, [1.0, 1.0], None), (1, [1.0, 1.0], None), (2, [1.0, 1.0], " A b"), (3, [1.0, 1.0], "a-B"), (4, None, "z"), (None, [0.0, 1.0], "z")]
    df = spark.createDataFrame(rows, "id int, v array<double>, kind string")
    got = varied_subset(df, "id", "v", "kind", 2, 10).collect()
    assert sorted(r.id for r in got) == [1, 2] and {r.kind for r in got} == {"", "a-b"}
    assert varied_subset(df, "id", "v", "kind", 2, 0).count() == 0 and varied_subset(df.limit(0), "id", "v", "kind", 2, 5).count() == 0


def test_cubes_whose_representatives_lie_far_apart_are_still_compared(spark):
    # the smallest ids of the two cubes are 3.45 apart along x, their other points 2.62
    p = np.array([[0.87, 0.1, 0.1], [4.32, 0.1, 0.1], [1.29, 0.1, 0.1], [3.91, 0.1, 0.1], [1.28, 0.1, 0.1], [3.92, 0.1, 0.1]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(p)), "c": p.tolist()}))
    assert len(brute_groups(p, 3.0, 5)) == 6
    assert {(r.root_id, r.id) for r in C.CellClusters(df, "id", "c").groups().collect()} == brute_groups(p, 3.0, 5)


def test_recall_over_many_cells_and_several_shards(spark):
    # 40 cells without any structure in about five shards
    x = np.random.default_rng(8).normal(size=(4000, 12)).astype(np.float32).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist()}))
    got = most_similar(df, "id", "v", 12, 5, target=100, most=200, shard_most=1000).toPandas()
    want = exact(x, 5)
    found = {(int(a), int(b)) for a, b in zip(got["key"], got["neighbor"])}
    assert not got.duplicated(["key", "neighbor"]).any() and got.groupby("key").size().eq(5).all()
    assert np.mean([(k, int(j)) in found for k in range(len(x)) for j in want[k]]) >= 0.9


def test_parallel_vectors_are_copies_of_one_direction(spark):
    rng = np.random.default_rng(9)
    x = [[s, 2 * s, -s] for s in (0.5, 1, 2, 3, 7)] * 10 + rng.normal(size=(30, 3)).tolist()
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, v array<double>")
    got = most_similar(df, "id", "v", 3, 5).toPandas()
    assert got.groupby("key").size().eq(5).all()
    assert set(got[got["key"] == "3"]["neighbor"]) == {"0", "1", "10", "11", "12"} and (got[got["key"] == "3"]["similarity"] == 1).all()


def groups_of(spark, p):
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(p)), "c": np.asarray(p).tolist()}))
    return {(r.root_id, r.id) for r in C.CellClusters(df, "id", "c").groups().collect()}


def test_points_far_out(spark):
    rng = np.random.default_rng(11)
    p = [rng.normal(0, 0.8, (6, 3)) + [x, y, 0] for x in (1.5e9, -1.5e9, 0, 3.6e6, -3.6e6, 1e12) for y in (0, 2.0e6)]
    p = np.vstack([*p, [[1e300, 0, 0]] * 5, [[1e300, 1e300, 0]] * 4])
    got = groups_of(spark, p)
    assert got == brute_groups(p, 3.0, 5) and len({r for r, _ in got}) == 13


@pytest.mark.parametrize("apart", [3.0, 3.0001])
def test_crowded_cubes_a_step_apart(spark, apart):
    # two walls of 40,000 points each, of which one pair may be exactly a step apart
    rng = np.random.default_rng(12)
    a, b = rng.uniform(0.1, 0.5, (40000, 3)).round(4), rng.uniform(0.1, 0.5, (40000, 3)).round(4)
    a[:, 0], b[:, 0] = 0.25 - np.abs(a[:, 1] - 0.3) / 100 - 0.0001, 0.25 + apart + np.abs(b[:, 1] - 0.3) / 100 + 0.0001
    a[7], b[9] = [0.25, 0.3, 0.3], [0.25 + apart, 0.3, 0.3]
    got = groups_of(spark, np.vstack([a, b]))
    assert len({r for r, _ in got}) == (1 if apart == 3.0 else 2) and len(got) == 80000


def test_step_tables_are_deleted(spark, tmp_path):
    import os

    from lumenfold.runtime import shared_dir

    folder = f"{shared_dir(spark)}/lumenfold"
    names = lambda: {n.rpartition("-")[0] for n in os.listdir(folder)}
    count = lambda: len(os.listdir(folder)) if os.path.isdir(folder) else 0
    before = count()
    rng = np.random.default_rng(3)
    p = np.vstack([np.cumsum(rng.normal(0, 1.2, (200, 3)), axis=0), rng.uniform(-40, 40, (200, 3))])
    assert groups_of(spark, p) == brute_groups(p, 3.0, 5)
    # what the result and further calls read stays: points, links, cubes, pivots, labels
    assert count() - before <= 6, names()
