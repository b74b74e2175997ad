"""Implausible readings and rolling totals: brute force, edge cases, and the block cuts."""

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import spikes
from lumenfold.operators.rolling import rolling_totals, surges
from lumenfold.operators.spikes import Limits, SpikeSettings, find_faults, score_readings

ST = SpikeSettings({"v": Limits(-100.0, 100.0)})


def readings(seed=0, n=900):
    rng = np.random.default_rng(seed)
    x = 10 + np.sin(np.arange(n) / 20) + rng.normal(0, 0.1, n)
    x[400:] += 5  # a lasting change of level
    x[600:680] += rng.normal(0, 0.15, 80)  # a noisier period
    bad = set()
    for at, size, by in ((100, 1, 2.0), (250, 2, -3.0), (700, 3, 4.0)):
        x[at:at + size] += by
        bad |= set(range(at, at + size))
    x[800:812] = x[800]
    bad |= set(range(800, 812))
    x[500] = 400
    return x, bad | {500}


@pytest.mark.parametrize("seed", range(4))
def test_faults_are_found_and_nothing_else(seed):
    x, bad = readings(seed)
    _, fault = find_faults(x, np.zeros(len(x), dtype=np.int64), ST.limits["v"], ST)
    assert set(np.flatnonzero(fault)) == bad


@pytest.mark.parametrize("n", [127, 128, 5000])
def test_a_constant_source_is_stuck_whatever_its_length(n):
    _, fault = find_faults(np.full(n, 3.5), np.zeros(n, dtype=np.int64), ST.limits["v"], ST)
    assert fault.all()


def test_many_faults_do_not_mask_each_other():
    rng = np.random.default_rng(3)
    x = 10 + rng.normal(0, 0.1, 4000)
    x[10::12] += 4.0  # every twelfth reading is a burst
    x[2000:2600] = 10.0
    seg = np.zeros(len(x), dtype=np.int64)
    a, b = find_faults(x, seg, ST.limits["v"], ST)[1], find_faults(x, seg, ST.limits["v"], ST, exhaustive=True)[1]
    assert a[2000:2600].all() and b.sum() > 800 and (a == b).all()


def test_forest_misses_nothing_that_an_exhaustive_check_finds():
    xs, segs = zip(*[(readings(s)[0], np.full(900, s)) for s in range(6)])
    x, seg = np.concatenate(xs), np.concatenate(segs)
    a, b = find_faults(x, seg, ST.limits["v"], ST)[1], find_faults(x, seg, ST.limits["v"], ST, exhaustive=True)[1]
    assert (a == b).all()


def test_blocks_do_not_change_the_result(spark):
    x, bad = readings(1, 3000)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "s": "a ", "t": np.arange(len(x)), "v": x}))
    for block in (512, 1 << 14):
        st = dataclasses.replace(ST, block=block)
        got = score_readings(df, "id", F.col("s"), F.col("t"), ["v"], st, faults_only=True).toPandas()
        assert set(got["id"]) == bad


def test_readings_edge_cases(spark):
    schema = "id bigint, s string, t bigint, v double, w double, score double, fault string, key int"
    rows = [(1, None, 1, 5.0, None, 0.0, "x", 1), (2, None, 2, 900.0, None, 0.0, "x", 1), (2, None, 2, 900.0, None, 0.0, "x", 1), (3, "A", None, float("nan"), 1.0, 0.0, "", 2),
            (4, " a", 1, None, 2.0, 0.0, "", 3), (5, "a", 1, 7.0, None, 1.0, None, None), (6, "A ", 1, 7.0, float("inf"), 1.0, None, None), (6, "A ", 1, 7.0, float("inf"), 1.0, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = score_readings(df, "id", F.col("s"), F.col("t"), ["v", "w"], dataclasses.replace(ST, limits={"v": Limits(0, 100), "w": Limits(0, 10)})).toPandas()
    assert sorted(zip(got["id"], got["field"], got["fault"])) == [(1, "v", False), (2, "v", True), (3, "v", True), (3, "w", False), (4, "w", False), (5, "v", False), (6, "v", False), (6, "w", True)]
    assert score_readings(df.limit(0), "id", F.col("s"), F.col("t"), ["v"], ST).count() == 0


def test_runs_of_equal_values():
    first, length = spikes._runs(np.array([1.0, 1, 2, 2, 2, 2]), np.array([0, 0, 0, 0, 1, 1]))
    assert first.tolist() == [0, 0, 2, 2, 4, 4] and length.tolist() == [2, 2, 2, 2, 2, 2]


def brute_rolling(rows):
    rows = {r for r in rows if None not in r and r[2] == r[2]}
    day = {}
    for d, t, u in rows:
        day[(d, t)] = day.get((d, t), 0) + round(u * 100)
    out = []
    for d in {k[0] for k in day}:
        ts = [t for e, t in day if e == d]
        for t in range(min(ts), max(ts) + 1):
            s = [sum(day.get((d, t - k), 0) for k in range(n)) / 100 for n in (7, 30)]
            out.append((d, t, s[0], s[1], min(ts)))
    return out


def test_rolling_against_brute_force_across_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(int(d), int(t), float(np.round(u, 2))) for d, t, u in zip(rng.integers(0, 3, 200), rng.integers(-80, 150, 200), rng.normal(5, 20, 200))]
    rows += rows[:20] + [(None, 1, 1.0), (1, None, 1.0), (1, 400, None), (2, 1, float("nan"))]
    df = spark.createDataFrame(rows, "d bigint, day bigint, units double").withColumn("first_day", F.lit("clash")).withColumn("cents", F.lit(0))
    want = sorted((d, t, round(a, 2), round(b, 2), f) for d, t, a, b, f in brute_rolling(rows))
    for block in (32, 1024):
        rolled = rolling_totals(df, "d", "day", "units", block_days=block)
        got = sorted((r.d, r.day, round(r.total_7, 2), round(r.total_30, 2), r.first_day) for r in rolled.collect())
        assert got == want
    hit = {(r.d, r.day) for r in surges(rolled, "d", "day").collect()}
    assert hit == {(d, t) for d, t, a, b, f in want if t >= f + 29 and b > 0 and 2 * round(a * 100) > round(b * 100)}
    assert rolling_totals(df.limit(0), "d", "day", "units").count() == 0
