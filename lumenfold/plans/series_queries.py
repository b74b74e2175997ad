"""Series, shape and state analytics over hourly series of the events table, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import kernels as K
from lumenfold.functions import udfs as U
from lumenfold.plans.vector_queries import embeddings
from lumenfold.sources.tables import table


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """(event_type, hour, cents): total value of each type and hour, in whole cents."""
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("bigint").alias("cents"))


def series(spark: SparkSession, folder: str) -> DataFrame:
    return U.ordered_series(hourly(spark, folder), ["event_type"], "hour", "cents")


def _by_type(call: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: series(spark, folder).select("event_type", call(F.col("series")).alias("r"))


def dfa_by_event_type(spark: SparkSession, folder: str) -> DataFrame:
    return _by_type(U.array_function("dimension_dfa"))(spark, folder).select("event_type", F.round("r", 6).alias("alpha"))


def dfa_drift(spark: SparkSession, folder: str) -> DataFrame:
    d = _by_type(lambda s: U.array_function("dimension_drift")(s, F.lit(128)))(spark, folder)
    return d.select("event_type", *[(F.round(f"r.{c}", 6) + 0.0).alias(c) for c in ("drift", "recent_alpha", "baseline_alpha")])


def change_points(spark: SparkSession, folder: str) -> DataFrame:
    d = _by_type(lambda s: U.array_function("change_point_detect")(s, F.lit(24), F.lit(1.0)))(spark, folder)
    return d.select("event_type", F.explode("r").alias("boundary"))


def periodogram_peaks(spark: SparkSession, folder: str) -> DataFrame:
    d = _by_type(lambda s: U.array_function("periodogram")(s, F.lit(5)))(spark, folder)
    return d.select("event_type", F.posexplode(F.arrays_zip("r.freqs", "r.power")).alias("pos", "p")).select("event_type", "pos", F.round("p.freqs", 6).alias("freq"), F.round("p.power", 2).alias("power"))


def spectral_entropy(spark: SparkSession, folder: str) -> DataFrame:
    d = _by_type(lambda s: U.array_function("spectrogram_entropy")(s, F.lit(64), F.lit(32)))(spark, folder)
    return d.select("event_type", F.posexplode("r").alias("frame", "h")).select("event_type", "frame", F.round("h", 6).alias("entropy"))


def entropy_change_points(spark: SparkSession, folder: str) -> DataFrame:
    d = _by_type(lambda s: U.array_function("spectrogram_entropy")(s, F.lit(32), F.lit(8)))(spark, folder)
    return d.select("event_type", F.explode(U.array_function("change_point_detect")(F.col("r"), F.lit(8), F.lit(2.0))).alias("boundary"))


def boxcount_by_event_type(spark: SparkSession, folder: str) -> DataFrame:
    """Box dimension of each type's (time, value) points."""
    p = _points(spark, folder)
    return p.select("event_type", F.round(U.array_function("dimension_boxcount")(F.col("xy"), F.lit(2)), 6).alias("dimension"))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    rows = hourly(spark, folder).withColumn("x", F.unix_timestamp("hour").cast("double") / 3600.0)
    w = rows.groupBy("event_type").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("cents").alias("y0"), F.max("cents").alias("y1"))
    rows = rows.join(w, "event_type").select("event_type", ((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))).alias("x"), ((F.col("cents") - F.col("y0")) / (F.col("y1") - F.col("y0"))).alias("y"))
    xy = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x", "y"))), lambda p: F.array(p["x"], p["y"])))
    return rows.groupBy("event_type").agg(xy.alias("xy"))


def lacunarity(spark: SparkSession, folder: str) -> DataFrame:
    r = U.array_udf(lambda p, d: K.lacunarity(p, int(d)), "double")(F.col("xy"), F.lit(2))
    return _points(spark, folder).select("event_type", F.round(r, 6).alias("lacunarity"))


def morphological_complexity(spark: SparkSession, folder: str) -> DataFrame:
    r = U.array_function("morphological_complexity")(F.col("xy"), F.lit(2))
    return _points(spark, folder).select("event_type", r.alias("r")).select("event_type", F.round("r.dimension", 6).alias("dimension"), F.round("r.lacunarity", 6).alias("lacunarity"))


def simhash_bits(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings(spark, folder).select("vec_id", F.lower(F.hex(U.fingerprints(F.col("embedding"), 16, 42))).alias("bits"))


def cycle_detect(spark: SparkSession, folder: str) -> DataFrame:
    """First cycle of each event type's hourly counts modulo 3, as one-byte states."""
    e = hourly(spark, folder).select("event_type", "hour", F.lpad(F.hex((F.col("cents") % 3).cast("bigint")), 2, "0").alias("h"))
    s = e.groupBy("event_type").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("hour", "h"))), lambda x: x["h"])).alias("states"))
    r = U.array_function("cycle_detect")(F.col("states"), F.lit(8))
    return s.select("event_type", r.alias("r")).select("event_type", "r.detected", "r.cycle_len", "r.at_index")


def detect_loop(spark: SparkSession, folder: str) -> DataFrame:
    """Loop detector over the embeddings of each label, as the states of one agent."""
    s = embeddings(spark, folder).groupBy("label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))), lambda x: x["v"])).alias("states"))
    return s.select("label", U.array_function("detect_loop")(F.col("states"), F.lit(64)).alias("r")).select("label", F.round("r.dfa_exponent", 6).alias("dfa_exponent"), "r.is_loop_detected")


def tda_h0_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Component deaths and cycle rank of the first two coordinates of each label's vectors; null for labels of more than 512 vectors."""
    xy = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")))), lambda p: F.array(p["x"], p["y"])))
    r = U.array_function("tda_persistence_diagram")(F.col("xy"), F.lit(2), F.lit(1), F.lit(0.1), F.lit(512))
    return embeddings(spark, folder).groupBy("label").agg(xy.alias("xy")).select("label", r.alias("r")).select("label", "r.n_h0_bars", "r.betti1", F.round(F.element_at("r.h0_bars", -1), 6).alias("last_death"))


def _shape(spark: SparkSession, folder: str) -> DataFrame:
    """One row per label: its vectors' first three coordinates and a chain of edges through them."""
    xyz = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v")))), lambda p: p["v"]))
    g = table(spark, folder, "embeddings").groupBy("label").agg(xyz.alias("p"), F.count(F.lit(1)).cast("int").alias("n"))
    chain = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.array(i.cast("double"), (i + 1).cast("double"))))
    return g.withColumn("edges", chain).withColumn("arcs", F.array_repeat(F.lit(2.0), F.col("n") - 1))


def vascular(spark: SparkSession, folder: str) -> DataFrame:
    r = U.array_function("vascular_network")(F.col("p"), F.col("edges"), F.col("arcs"))
    return _shape(spark, folder).select("label", r.alias("r")).select("label", F.round("r.mean_tortuosity", 6).alias("mean_tortuosity"), F.round("r.branch_density", 6).alias("branch_density"))


def nerve(spark: SparkSession, folder: str) -> DataFrame:
    r = U.array_function("nerve_plexus_metric")(F.col("p"), F.lit(3), F.col("edges"))
    return _shape(spark, folder).select("label", r.alias("r")).select("label", F.round("r.fiber_length_density", 6).alias("fiber_length_density"), F.round("r.branch_density", 6).alias("branch_density"))


def cortical(spark: SparkSession, folder: str) -> DataFrame:
    faces = F.array(*[F.lit(float(x)) for x in (0, 1, 2, 0, 2, 3)])
    r = U.array_function("cortical_folding")(F.col("p"), faces)
    return _shape(spark, folder).select("label", r.alias("r")).select("label", F.round("r.mesh_area", 6).alias("mesh_area"), F.round("r.hull_area", 6).alias("hull_area"), F.round("r.gyrification_index", 6).alias("gyrification_index"))


# ---- optimization over monthly order totals -----------------------------------------------------

def market(spark: SparkSession, folder: str) -> DataFrame:
    """One row: mean and covariance of the monthly growth of order totals per nation of customers."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("month")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    r = m.select("nation", "month", (F.log(F.col("cents") / 1e6)).alias("r"))
    pairs = r.alias("a").join(r.alias("b"), "month").groupBy(F.col("a.nation").alias("i"), F.col("b.nation").alias("j")).agg(F.covar_pop("a.r", "b.r").alias("c"))
    mu = r.groupBy("nation").agg(F.avg("r").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nation", "m"))), lambda x: x["m"]).alias("mu"))
    cov = pairs.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "c"))), lambda x: x["c"]).alias("cov"))
    return mu.crossJoin(F.broadcast(cov))  # one row each


def portfolio_k2(spark: SparkSession, folder: str) -> DataFrame:
    r = U.array_function("optimize_portfolio")(F.col("mu"), F.col("cov"), F.lit(2))
    return market(spark, folder).select(r.alias("r")).select(F.round("r.sharpe", 6).alias("sharpe"), F.posexplode("r.weights").alias("asset", "weight")).where("weight > 0").withColumn("weight", F.round("weight", 6))


def portfolio_multimodal(spark: SparkSession, folder: str) -> DataFrame:
    r = U.array_function("optimize_portfolio_multimodal")(F.col("mu"), F.col("cov"), F.lit(2), F.lit(16), F.lit(0.34), F.lit(0.5), F.lit(1))
    return market(spark, folder).select(F.posexplode(r).alias("candidate", "r")).select("candidate", F.round("r.sharpe", 6).alias("sharpe"), F.size(F.filter("r.weights", lambda x: x > 0)).alias("held"))


def portfolio_pareto(spark: SparkSession, folder: str) -> DataFrame:
    r = U.array_function("optimize_portfolio_multimodal_pareto")(F.col("mu"), F.col("cov"), F.lit(3), F.lit(16), F.lit(8), F.lit(1))
    return market(spark, folder).select(F.posexplode(r).alias("candidate", "r")).select("candidate", F.round("r.return", 6).alias("return"), F.round("r.risk", 6).alias("risk"))


def subset_allocation(spark: SparkSession, folder: str) -> DataFrame:
    """The best three suppliers by balance, at most half each."""
    v = table(spark, folder, "supplier").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_acctbal"))), lambda x: x["s_acctbal"].cast("double")).alias("v"))
    r = U.array_function("optimize_subset")(F.col("v"), F.transform("v", lambda x: F.lit(0.5)), F.lit(3))
    return v.select(r.alias("r")).select(F.round("r.score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    dfa_by_event_type, dfa_drift, change_points, periodogram_peaks, spectral_entropy, entropy_change_points, boxcount_by_event_type, lacunarity, morphological_complexity,
    simhash_bits, cycle_detect, detect_loop, tda_h0_bars, vascular, nerve, cortical, portfolio_k2, portfolio_multimodal, portfolio_pareto, subset_allocation)}

HOURLY = """WITH hourly AS (SELECT event_type, date_trunc('hour', ts) AS hour, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL),
s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i, cents::DOUBLE AS x, count(*) OVER (PARTITION BY event_type) AS n FROM hourly)"""


def _dfa_sql(rows: str, key: str) -> str:
    """CTEs that end in alpha_{key}: the exponent of the rows (event_type, i from 0, x, n) of CTE `rows`."""
    return f"""
mean_{key} AS (SELECT event_type, avg(x) AS m FROM {rows} GROUP BY ALL),
y_{key} AS (SELECT event_type, i, n, sum(x - m) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING) AS y FROM {rows} JOIN mean_{key} USING (event_type)),
scales_{key} AS (SELECT DISTINCT floor(4 * pow(1.25, k) + 0.5)::BIGINT AS sc FROM range(0, 60) t(k)),
box_{key} AS (SELECT event_type, sc, i // sc AS b, regr_syy(y, i) - CASE WHEN regr_sxx(y, i) > 0 THEN regr_sxy(y, i) * regr_sxy(y, i) / regr_sxx(y, i) ELSE 0 END AS rest
  FROM y_{key} JOIN scales_{key} ON sc <= n // 4 WHERE i < (n // sc) * sc GROUP BY event_type, sc, i // sc),
f_{key} AS (SELECT event_type, sc, sqrt(sum(rest) / (count(*) * sc)) AS f FROM box_{key} GROUP BY event_type, sc),
alpha_{key} AS (SELECT event_type, regr_slope(ln(f), ln(sc)) AS alpha FROM f_{key} GROUP BY event_type)"""


_BOXES = """, p0 AS (SELECT event_type, epoch(hour) / 3600.0 AS x, cents AS y FROM hourly),
p AS (SELECT event_type, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS x, (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w)::DOUBLE AS y, count(*) OVER w AS n FROM p0 WINDOW w AS (PARTITION BY event_type))"""
SQL = {
    "dfa_by_event_type": f"{HOURLY}, {_dfa_sql('s', 'a')} SELECT event_type, round(alpha, 6) AS alpha FROM alpha_a",
    "dfa_drift": f"""{HOURLY}, recent AS (SELECT event_type, i - (n - 128) AS i, x, 128 AS n FROM s WHERE i >= n - 128), old AS (SELECT event_type, i, x, n - 128 AS n FROM s WHERE i < n - 128),
        {_dfa_sql('recent', 'r')}, {_dfa_sql('old', 'o')} SELECT event_type, round(r.alpha - o.alpha, 6) + 0.0 AS drift, round(r.alpha, 6) + 0.0 AS recent_alpha, round(o.alpha, 6) + 0.0 AS baseline_alpha
        FROM alpha_r r JOIN alpha_o o USING (event_type)""",
    "periodogram_peaks": f"""{HOURLY}, c AS (SELECT event_type, i, n, x - avg(x) OVER (PARTITION BY event_type) AS x FROM s),
        f AS (SELECT event_type, k, any_value(n) AS n, (pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) / any_value(n) AS power
          FROM c JOIN range(1, 2000) t(k) ON k <= n // 2 GROUP BY event_type, k),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(power, 6) DESC, k) - 1 AS pos FROM f)
        SELECT event_type, pos::INT AS pos, round(k / n, 6) AS freq, round(power, 2) AS power FROM r WHERE pos < 5""",
    "spectral_entropy": f"""{HOURLY}, fr AS (SELECT event_type, f AS frame, i - f * 32 AS t, x FROM s JOIN range(0, 4096) g(f) ON i >= f * 32 AND i < f * 32 + 64 WHERE f * 32 + 64 <= n),
        w AS (SELECT event_type, frame, t, (x - avg(x) OVER (PARTITION BY event_type, frame)) * (0.5 - 0.5 * cos(2 * pi() * t / 64)) AS x FROM fr),
        p AS (SELECT event_type, frame, k, pow(sum(x * cos(2 * pi() * k * t / 64)), 2) + pow(sum(x * sin(2 * pi() * k * t / 64)), 2) AS p FROM w, range(1, 33) g(k) GROUP BY event_type, frame, k),
        q AS (SELECT event_type, frame, p / sum(p) OVER (PARTITION BY event_type, frame) AS q FROM p)
        SELECT event_type, frame::INT AS frame, round(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(32), 6) AS entropy FROM q GROUP BY ALL""",
    "lacunarity": f"""{HOURLY}{_BOXES}, m AS (SELECT event_type, least(7, floor(x * 8)) AS a, least(7, floor(y * 8)) AS b, count(*) AS m FROM p GROUP BY ALL)
        SELECT event_type, round((sum(m * m) / 64.0) / pow(sum(m) / 64.0, 2), 6) AS lacunarity FROM m GROUP BY event_type""",
    "boxcount_by_event_type": f"""{HOURLY}{_BOXES}, b AS (SELECT event_type, k, any_value(n) AS n, count(DISTINCT (least(pow(2, k) - 1, floor(x * pow(2, k))), least(pow(2, k) - 1, floor(y * pow(2, k))))) AS c
          FROM p, range(1, 21) t(k) GROUP BY event_type, k),
        ok AS (SELECT *, bool_or(c > 0.316 * n) OVER (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING) AS full_ FROM b)
        SELECT event_type, CASE WHEN count(*) FILTER (NOT full_) >= 3 THEN round(regr_slope(ln(c), k * ln(2)) FILTER (NOT full_), 6) END AS dimension FROM ok GROUP BY event_type""",
    "simhash_bits": """WITH pl AS (SELECT b, i, (m // 65536) % 2 AS odd FROM (SELECT b, i, ((((b * 7919 + i * 104729 + 42 * 15485863 + 12345) % 2147483647) * 48271 % 2147483647) * 48271 + b + 1) % 2147483647 AS m
          FROM range(0, 16) x(b), range(0, 64) y(i))),
        pr AS (SELECT vec_id, b, sum((embedding::DOUBLE[])[i + 1] * CASE WHEN odd = 0 THEN 1 ELSE -1 END) AS s FROM embeddings, pl GROUP BY vec_id, b)
        SELECT vec_id, printf('%04x', sum(CASE WHEN s >= 0 THEN pow(2, 15 - b)::BIGINT ELSE 0 END)::BIGINT) AS bits FROM pr GROUP BY vec_id""",
    "subset_allocation": """SELECT round(0.5 * sum(s_acctbal), 6) AS score FROM (SELECT s_acctbal FROM supplier ORDER BY s_acctbal DESC LIMIT 2)""",
}
_CHANGE = """bd AS (SELECT a.event_type, a.i AS b, avg(p.x) AS m1, avg(q.x) AS m2, var_pop(p.x) AS v1, var_pop(q.x) AS v2 FROM {rows} a
  JOIN {rows} p ON p.event_type = a.event_type AND p.i >= a.i - {w} AND p.i < a.i JOIN {rows} q ON q.event_type = a.event_type AND q.i >= a.i AND q.i < a.i + {w}
  WHERE a.i >= {w} AND a.i <= a.n - {w} GROUP BY a.event_type, a.i),
fl AS (SELECT *, abs(m2 - m1) AS gap, abs(m2 - m1) > {thr} * sqrt((v1 + v2) / 2) AS by_mean, greatest(v1, v2) > {thr} * {thr} * least(v1, v2) AS by_var FROM bd),
runs AS (SELECT *, b - row_number() OVER (PARTITION BY event_type ORDER BY b) AS run FROM fl WHERE by_mean OR by_var),
best AS (SELECT *, bool_or(by_mean) OVER r AS any_mean, ln(greatest(v1, v2, 1e-300)) - ln(greatest(least(v1, v2), 1e-300)) AS ratio FROM runs WINDOW r AS (PARTITION BY event_type, run)),
pick AS (SELECT event_type, b, row_number() OVER (PARTITION BY event_type, run ORDER BY CASE WHEN any_mean THEN (CASE WHEN by_mean THEN gap ELSE -1 END) ELSE ratio END DESC, b) AS rn FROM best)
SELECT event_type, b::INT AS boundary FROM pick WHERE rn = 1"""
SQL["change_points"] = f"{HOURLY}, " + _CHANGE.format(rows="s", w=24, thr=1.0)
SQL["morphological_complexity"] = f"SELECT event_type, dimension, lacunarity FROM ({SQL['boxcount_by_event_type']}) JOIN ({SQL['lacunarity']}) USING (event_type)"


def drift_sql(window: int, kind: str) -> str:
    """One row (alpha of all, recent_alpha, baseline_alpha) of one event type, as CTE text ending in a SELECT."""
    return f"""{HOURLY}, one AS (SELECT * FROM s WHERE event_type = '{kind}'),
        recent AS (SELECT event_type, i - (n - {window}) AS i, x, {window} AS n FROM one WHERE i >= n - {window}), old AS (SELECT event_type, i, x, n - {window} AS n FROM one WHERE i < n - {window}),
        {_dfa_sql('one', 'w')}, {_dfa_sql('recent', 'r')}, {_dfa_sql('old', 'o')}
        SELECT w.alpha, r.alpha AS recent_alpha, o.alpha AS baseline_alpha FROM alpha_w w JOIN alpha_r r USING (event_type) JOIN alpha_o o USING (event_type)"""


def brent_sql(states: str, again: bool) -> str:
    """Brent's detector stepped by recursion over `states` (key, i from 0, st): every step with the length of the cycle it closes, until the first one or (again) to the end."""
    return f"""WITH RECURSIVE st AS ({states}), r AS (SELECT key, 0::BIGINT AS i, 1::BIGINT AS power, 0::BIGINT AS lam, st AS ck, 0::BIGINT AS hit FROM st WHERE i = 0
      UNION ALL SELECT r.key, st.i, CASE WHEN st.st = r.ck THEN 1 WHEN r.lam + 1 = r.power THEN 2 * r.power ELSE r.power END, CASE WHEN st.st = r.ck OR r.lam + 1 = r.power THEN 0 ELSE r.lam + 1 END,
        CASE WHEN st.st = r.ck OR r.lam + 1 = r.power THEN st.st ELSE r.ck END, CASE WHEN st.st = r.ck THEN r.lam + 1 ELSE 0 END
      FROM r JOIN st ON st.key = r.key AND st.i = r.i + 1 {'' if again else 'WHERE r.hit = 0'})"""


_POINTS = """WITH p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
  c AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS chord FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id))"""
_PAIRS = """WITH m AS (SELECT c_nationkey AS nation, date_trunc('month', o_orderdate) AS month, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  r AS (SELECT nation, month, ln(cents / 1e6) AS r FROM m), mu AS (SELECT nation, avg(r) AS m, row_number() OVER (ORDER BY nation) - 1 AS asset FROM r GROUP BY nation),
  cov AS (SELECT a.nation AS i, b.nation AS j, covar_pop(a.r, b.r) AS c FROM r a JOIN r b USING (month) GROUP BY ALL),
  pair AS (SELECT x.asset AS a, y.asset AS b, x.m AS ma, y.m AS mb, v.c AS va, w.c AS vb, u.c AS vab FROM mu x JOIN mu y ON x.asset < y.asset
    JOIN cov v ON v.i = x.nation AND v.j = x.nation JOIN cov w ON w.i = y.nation AND w.j = y.nation JOIN cov u ON u.i = x.nation AND u.j = y.nation),
  w AS (SELECT *, vb * ma - vab * mb AS wa, va * mb - vab * ma AS wb FROM pair),
  best AS (SELECT *, (wa * ma + wb * mb) / sqrt(wa * wa * va + wb * wb * vb + 2 * wa * wb * vab) AS sharpe FROM w WHERE wa > 0 AND wb > 0 ORDER BY sharpe DESC LIMIT 1)"""
SQL |= {
    "vascular": _POINTS + " SELECT label, round(avg(2 / chord), 6) AS mean_tortuosity, 0.0::DOUBLE AS branch_density FROM c GROUP BY label",
    "nerve": _POINTS + " SELECT label, round(sum(chord) / ((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))), 6) AS fiber_length_density, 0.0::DOUBLE AS branch_density FROM c GROUP BY label",
    "cycle_detect": brent_sql("SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i, cents % 3 AS st FROM (SELECT event_type, date_trunc('hour', ts) AS hour, "
                              "sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL)", False)
    + " SELECT key AS event_type, max(hit) > 0 AS detected, nullif(max(hit), 0) AS cycle_len, max(i) FILTER (WHERE hit > 0) AS at_index FROM r GROUP BY key",
    "portfolio_k2": _PAIRS + """ SELECT round(sharpe, 6) AS sharpe, a AS asset, round(wa / (wa + wb), 6) AS weight FROM best
      UNION ALL SELECT round(sharpe, 6), b, round(wb / (wa + wb), 6) FROM best""",
}
BEST_PAIR_SQL = _PAIRS + " SELECT round(sharpe, 6) AS sharpe FROM best"
