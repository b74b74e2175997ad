"""Implausible readings per source: isolation forest, physical limits, and a check of each candidate.

Rows of a source are cut along their order into blocks of about `block` readings with a
halo of neighbours on either side, so no source sits whole in one task; small sources are
one block. Blocks are bundled, and each bundle is scored in one call with arrays.

Of each block and field a forest is grown on four features of every reading: level
(distance from the readings around it in units of the block's usual scatter), difference
to its neighbours, seasonal residual (against one period before and after) and length of
the run of equal values. Every reading gets a score, and the score decides what may be a
spike: readings that score at least `threshold`, with the two on either side, are held against the
definition of a burst (at most three readings that leave a level which is resumed
afterwards), in sources of any size. Two kinds of faults need no score, being rules: runs
of `stuck` equal values, and readings outside the physical limits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import isolation
from lumenfold.runtime import join_sized, materialize, tidy_key

HALO = 40
#: What features count up to, and the range in which cuts are drawn at least: units of scatter, and the binary logarithm of a run.
FEATURE_MOST, REACH = 40.0, np.array([10.0, 10.0, 10.0, 6.0])
#: Kinds of faults, the stronger rule last.
KINDS = ("", "spike", "stuck", "limit")


@dataclass(frozen=True)
class Limits:
    low: float
    high: float
    open_low: bool = False
    open_high: bool = False


@dataclass(frozen=True)
class SpikeSettings:
    limits: dict[str, Limits] = field(default_factory=dict)
    trees: int = 24
    sample: int = 64
    depth: int = 8
    threshold: float = 0.42
    bound: float = 6.5
    stuck: int = 8
    block: int = 16384
    bundle: int = 49152
    seed: int = 7


# ---- array kernels -------------------------------------------------------------------

def _runs(x: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row the start and the length of its run of equal values inside its segment."""
    edge = np.r_[True, (x[1:] != x[:-1]) | (segment[1:] != segment[:-1])] if len(x) else np.empty(0, dtype=bool)
    first = np.flatnonzero(edge)
    length = np.diff(np.r_[first, len(x)])
    return np.repeat(first, length), np.repeat(length, length)


def _shifted(x: np.ndarray, segment: np.ndarray, by: int) -> np.ndarray:
    """x at the row `by` further on, NaN beyond the segment."""
    out = np.full(len(x), np.nan)
    if abs(by) < len(x):
        to, of = (slice(0, len(x) - by), slice(by, None)) if by > 0 else (slice(-by, None), slice(0, len(x) + by))
        out[to] = np.where(segment[to] == segment[of], x[of], np.nan)
    return out


def _median(stack: np.ndarray) -> np.ndarray:
    """Median over axis 0 without NaN; NaN where all are."""
    s = np.sort(stack, axis=0)
    k = np.sum(~np.isnan(s), axis=0)
    at = np.arange(s.shape[1])
    return (s[np.maximum(k - 1, 0) // 2, at] + s[k // 2 if len(s) > 1 else k * 0, at]) / 2 if len(s) else np.full(stack.shape[1], np.nan)


def _scatter(x: np.ndarray, segment: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int = 32) -> np.ndarray:
    """Usual scatter around every reading: robust, from second differences, in chunks, held near the segment's own.

    Second differences leave out levels, drifts and slow cycles. A chunk's value is
    smoothed with its two neighbours and kept within 0.75 to 4 times the segment's.
    """
    gap = np.abs(x - (_shifted(x, segment, -1) + _shifted(x, segment, 1)) / 2)
    gap[gap == 0] = np.nan  # stuck and coarse values say nothing of the scatter
    local = np.arange(len(x)) - starts[segment]
    per = -(-sizes // chunk)
    base = np.r_[0, np.cumsum(per)]
    cell = base[segment] + local // chunk
    grid = np.full((base[-1], chunk), np.nan)
    grid[cell, local % chunk] = gap
    mad = _median(np.ascontiguousarray(grid.T)) * (1.4826 / np.sqrt(1.5))
    owner = np.repeat(np.arange(len(sizes)), per)
    smooth = _median(np.stack([_shifted(mad, owner, -1), mad, _shifted(mad, owner, 1)]))
    order = np.lexsort((mad, owner))
    valid = np.bincount(owner, ~np.isnan(mad), len(sizes)).astype(np.int64)
    usual = np.where(valid > 0, mad[order][np.minimum(base[:-1] + np.maximum(valid - 1, 0) // 2, len(mad) - 1)], np.nan)
    whole = np.where(np.isnan(usual) | (usual <= 0), 1e-12, usual)
    return np.clip(np.where(np.isnan(smooth), whole[owner], smooth), 0.75 * whole[owner], 4 * whole[owner])[cell]


def _period(x: np.ndarray) -> int:
    """The lag of the highest peak of the autocorrelation, 0 if none stands out."""
    if len(x) < 48:
        return 0
    low, high = np.quantile(x, [0.02, 0.98])
    y = np.clip(x, low, high)
    y = y - np.linspace(y[: len(y) // 4].mean(), y[-(len(y) // 4):].mean(), len(y))
    y -= y.mean()
    power = np.abs(np.fft.rfft(y, 1 << int(np.ceil(np.log2(2 * len(y)))))) ** 2
    acf = np.fft.irfft(power)[: len(y) // 3]
    if acf[0] <= 0:
        return 0
    acf = acf / acf[0]
    peak = np.flatnonzero((acf[2:-1] > acf[1:-2]) & (acf[2:-1] >= acf[3:])) + 2
    peak = peak[acf[peak] > 0.3]
    return int(peak[acf[peak].argmax()]) if len(peak) else 0


def _features(x: np.ndarray, segment: np.ndarray, starts: np.ndarray, sizes: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = _scatter(x, segment, starts, sizes)
    level = np.abs(x - _median(np.stack([_shifted(x, segment, k) for k in (-6, -5, -4, -3, 3, 4, 5, 6)])))
    step = np.fmax(np.abs(x - _shifted(x, segment, -1)), np.abs(x - _shifted(x, segment, 1)))
    lag = np.zeros(len(x), dtype=np.int64)
    for k, (a, n) in enumerate(zip(starts, sizes)):
        lag[a:a + n] = _period(x[a:a + n])
    at, end = np.arange(len(x)), (starts + sizes)[segment]
    before = np.where((lag > 0) & (at - lag >= starts[segment]), x[np.maximum(at - lag, 0)], np.nan)
    after = np.where((lag > 0) & (at + lag < end), x[np.minimum(at + lag, len(x) - 1)], np.nan)
    season = np.fmin(np.abs(x - before), np.abs(x - after))
    f = np.stack([level / s, step / s, season / s])
    return np.vstack([np.minimum(np.nan_to_num(f, nan=0.0, posinf=FEATURE_MOST), FEATURE_MOST), np.log2(run)[None, :]]).astype(np.float32), s


def _bursts(x: np.ndarray, s: np.ndarray, segment: np.ndarray, at: np.ndarray, bound: float, side: int = 8) -> np.ndarray:
    """Which rows `at` lie in a burst of at most three readings away from a level that is resumed."""
    hit = np.zeros(len(at), dtype=bool)
    n = len(x)

    def near(index: np.ndarray) -> np.ndarray:
        ok = (index >= 0) & (index < n)
        safe = np.clip(index, 0, n - 1)
        return np.where(ok & (segment[safe] == segment[at]), x[safe], np.nan)

    for length in (1, 2, 3):
        for place in range(length):
            first, last = at - place, at - place + length - 1
            before = np.stack([near(first - k) for k in range(1, side + 1)])
            after = np.stack([near(last + k) for k in range(1, side + 1)])
            enough = (np.sum(~np.isnan(before[:4]), axis=0) >= 3) & (np.sum(~np.isnan(after[:4]), axis=0) >= 3)
            a, b = _median(before), _median(after)
            mid = (a + b) / 2
            body = np.stack([near(first + k) for k in range(length)])
            away = np.min(np.abs(body - mid), axis=0)
            # the readings next to the burst must be back at the level, or the burst is longer
            back = np.fmax(np.abs(before[0] - mid), np.abs(after[0] - mid))
            hit |= enough & (away >= bound * s[at]) & (np.abs(a - b) <= 0.5 * away) & (back <= 0.6 * away)
    return hit


def find_faults(value: np.ndarray, segment: np.ndarray, limits: Limits, st: SpikeSettings, exhaustive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Score and kind of fault (place in KINDS, 0: none) of every reading; rows are sorted by segment (0, 1, ..) and order, none is null.

    `exhaustive` checks every reading against the definition of a spike instead of the forest's candidates (for tests).
    """
    n = len(value)
    if n == 0:
        return np.empty(0, dtype=np.float32), np.empty(0, dtype=np.int8)
    sizes = np.bincount(segment)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    bad = ~(np.where(limits.open_low, value > limits.low, value >= limits.low) & np.where(limits.open_high, value < limits.high, value <= limits.high))
    run = _runs(value, segment)[1]
    # for the features an impossible value stands at the last possible one of its segment
    keep = np.where(bad, -1, np.arange(n))
    last = np.maximum.accumulate(keep)
    good = (last >= 0) & (segment[np.maximum(last, 0)] == segment)
    x = np.where(good, value[np.maximum(last, 0)], np.nan)
    lost = np.isnan(x)
    if lost.any():  # no possible value before: the next one, or 0 where the segment has none
        ahead = np.minimum.accumulate(np.where(bad, n, np.arange(n))[::-1])[::-1]
        fits = (ahead < n) & (segment[np.minimum(ahead, n - 1)] == segment)
        x = np.where(lost, np.where(fits, value[np.minimum(ahead, n - 1)], 0.0), x)
    f, s = _features(x, segment, starts, sizes, run)
    forest = isolation.grow(f, starts, sizes, st.trees, st.sample, st.depth, REACH, np.random.default_rng(st.seed))
    scores = isolation.score(forest, f, segment)
    candidate = (scores >= st.threshold) | exhaustive
    near = candidate.copy()
    for k in (1, 2):
        near[k:] |= candidate[:-k]
        near[:-k] |= candidate[k:]
    at = np.flatnonzero(near & ~bad)
    kind = np.zeros(n, dtype=np.int8)
    kind[at[_bursts(x, s, segment, at, st.bound)]] = 1
    kind[run >= st.stuck] = 2
    kind[bad] = 3
    return scores, kind


# ---- plan ------------------------------------------------------------------------------

def _blocks(rows: DataFrame, sources: DataFrame, st: SpikeSettings) -> DataFrame:
    """rows (key, ord, ..) with part: the block, and core: whether the row is the block's own or its halo's.

    Sources of at most `block` rows are one block. Longer ones are cut by counts of equal
    stretches of their order; only those counts are sorted, not the rows.
    """
    spans = sources.where(F.col("n") > st.block)
    if spans.isEmpty():
        return rows.select("*", F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("core"))
    cells = F.greatest(F.lit(1), F.ceil(F.col("n") / 256)).cast("bigint")
    cell = F.floor((F.col("ord") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * cells).cast("bigint")
    rows = join_sized(rows, spans, ["key"], "left").withColumn("cell", F.when(F.col("n").isNotNull(), cell)).drop("n", "lo", "hi")
    counts = rows.where("cell is not null").groupBy("key", "cell").agg(F.count(F.lit(1)).alias("m"))
    by_cell = Window.partitionBy("key").orderBy("cell")
    counts = counts.withColumn("s", F.coalesce(F.sum("m").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("own", F.dense_rank().over(Window.partitionBy("key").orderBy(F.floor(F.col("s") / st.block))))
    whole = Window.partitionBy("key", "own")
    # the first and last HALO * 4 rows of a block are also the halo of the block before and after it
    counts = counts.withColumn("head", (F.col("s") - F.min("s").over(whole) < HALO * 4).cast("int")) \
        .withColumn("tail", (F.max(F.col("s") + F.col("m")).over(whole) - F.col("s") - F.col("m") < HALO * 4).cast("int"))
    plan = counts.select("key", "cell", "own", F.explode(F.sequence(F.col("own") - F.col("head"), F.col("own") + F.col("tail"))).alias("part")) \
        .select("key", "cell", F.col("part").cast("bigint"), (F.col("part") == F.col("own")).alias("core"))
    joined = join_sized(rows, materialize(plan, "blocks"), ["key", "cell"], "left")
    return joined.drop("cell").withColumn("part", F.coalesce("part", F.lit(0))).withColumn("core", F.coalesce("core", F.lit(True)))


def score_readings(df: DataFrame, id: str, source: Column, order: Column, fields: list[str], st: SpikeSettings, faults_only: bool = False) -> DataFrame:
    """(id, field, value, score, fault, kind): one row per non-null reading of `fields`.

    kind is 'spike', 'stuck', 'limit' or empty. Rows delivered twice count once. Sources are told apart without blanks and case. Rows
    without a source or an order belong to none: only the physical limits judge them (score
    null). NaN and infinite readings are faults. Ties in the order are put by id. Tables
    without rows give none; other columns, whatever their names, are not read.
    """
    spark = df.sparkSession
    base = df.select(F.col(id).alias("id"), tidy_key(source).alias("key"), order.cast("double").alias("ord"),
                     *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(fields)])
    known = base.where("key is not null and ord is not null")
    sources = materialize(known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")), "sources")
    total = sources.agg(F.sum("n")).head()[0] or 0
    rows = _blocks(known, sources, st)
    bundles = max(spark.sparkContext.defaultParallelism, -(-total // st.bundle))
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("key", "part"), F.lit(bundles)))
    names, count, bounds = list(fields), len(fields), [st.limits.get(c, Limits(-np.inf, np.inf, True, True)) for c in fields]

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "part", "ord", "id"], kind="stable")
        key = pdf["key"].to_numpy()
        part, ident = pdf["part"].to_numpy(), pdf["id"].to_numpy()
        new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        once = new | np.r_[True, ident[1:] != ident[:-1]]
        seg, core = np.cumsum(new)[once], pdf["core"].to_numpy()[once]
        ident = ident[once]
        parts = []
        for k in range(count):
            v = pdf[f"v{k}"].to_numpy(dtype=np.float64, na_value=np.nan)[once]
            there = ~pdf[f"z{k}"].to_numpy(dtype=bool)[once]
            segment = np.unique(seg[there], return_inverse=True)[1]
            scores, kind = find_faults(v[there], segment, bounds[k], st)
            show = core[there] & (kind > 0 if faults_only else True)
            parts.append(pd.DataFrame({"id": ident[there][show], "field": names[k], "value": v[there][show], "score": scores[show].astype(np.float64), "fault": kind[show] > 0, "kind": np.array(KINDS, dtype=object)[kind[show]]}))
        return pd.concat(parts)

    schema = f"id {df.schema[id].dataType.simpleString()}, field string, value double, score double, fault boolean, kind string"
    for k in range(count):
        rows = rows.withColumn(f"z{k}", F.col(f"v{k}").isNull())
    scored = rows.groupBy("bundle").applyInPandas(judge, schema)
    verdicts = []
    for k, c in enumerate(fields):
        b, v = bounds[k], F.col(f"v{k}")
        fine = (v > b.low if b.open_low else v >= b.low) & (v < b.high if b.open_high else v <= b.high) & ~F.isnan(v)
        verdicts.append(F.struct(F.lit(c).alias("field"), v.alias("value"), F.lit(None).cast("double").alias("score"), (~fine).alias("fault"), F.when(fine, "").otherwise("limit").alias("kind")))
    stray = base.where("key is null or ord is null").select("id", F.explode(F.array(*verdicts)).alias("r")).select("id", "r.*").where("value is not null")
    stray = (stray.where("fault") if faults_only else stray).dropDuplicates(["id", "field"])
    out = scored.unionByName(stray)
    return out.where("fault") if faults_only else out
