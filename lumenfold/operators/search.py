"""Nearest-neighbour search over tables of vectors.

All searches are exact: the distance is an expression of the scan, the query a constant of
the plan, and the k best rows come from a top-k that keeps k rows per task. Restrictions
(a cohort, a filter) go below the distance. Ties are put by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import vector as V
from lumenfold.runtime import join_sized, materialize

METRICS = {"cosine": V.cosine_distance_to, "l2": lambda v, q: V.l2_distance(v, V.lit_vector(q)), "ip": lambda v, q: V.negative_inner_product(v, V.lit_vector(q))}


def check_vectors(df: DataFrame, vec: str, dim: int, mode: str = "error") -> DataFrame:
    """df with rows of a null or other-length vector skipped (mode "skip") or raising an error."""
    bad = F.col(vec).isNull() | (F.size(vec) != dim)
    if mode == "skip":
        return df.where(~bad)
    return df.withColumn(vec, F.when(bad, F.raise_error(F.lit("malformed vector or vector dim mismatch")).cast(df.schema[vec].dataType)).otherwise(F.col(vec)))


def vector_of(df: DataFrame, id: str, vec: str, value) -> list[float]:
    """The vector of one row."""
    row = df.where(F.col(id) == value).select(vec).head()
    if row is None:
        raise ValueError(f"no row with {id} {value}")
    return [float(x) for x in row[0]]


def knn(df: DataFrame, id: str, vec: str, query: list[float], k: int, metric: str = "cosine", penalty: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(id, distance): the k rows nearest to the query, with the columns `keep`."""
    if k <= 0:
        raise ValueError("k must be positive")
    d = METRICS[metric](F.col(vec), query)
    d = d if penalty is None else d + penalty
    return df.select(F.col(id), d.alias("distance"), *(keep or [])).orderBy("distance", id).limit(k)


def hybrid_knn(df: DataFrame, id: str, vec: str, query: list[float], cohort: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """knn among the rows whose id is in `cohort` (one column of ids); the restriction comes before any distance."""
    ids = cohort.select(F.col(cohort.columns[0]).alias(id)).distinct()
    return knn(df.join(ids, id, "left_semi"), id, vec, query, k, metric)


def trajectory_knn(df: DataFrame, id: str, vec: str, baseline: list[float], current: list[float], k: int) -> DataFrame:
    """knn around the direction from baseline to current."""
    return knn(df, id, vec, (np.asarray(current) - np.asarray(baseline)).tolist(), k)


def cross_modal_knn(df: DataFrame, id: str, vec: str, first: list[float], second: list[float], alpha: float, k: int) -> DataFrame:
    """knn around the concatenation of first * alpha and second * (1 - alpha)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in 0..1")
    return knn(df, id, vec, [*(alpha * x for x in first), *((1 - alpha) * x for x in second)], k)


def with_scan_position(df: DataFrame, id: str) -> DataFrame:
    """scan_pos: the 0-based place of every row in the order of ids, from counts per range of ids, not from one sorted task."""
    # written once: range bounds come from a sample and need not be the same a second time
    ordered = materialize(df.repartitionByRange(id).sortWithinPartitions(id).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    base = F.shiftright("_m", 33)
    counts = ordered.groupBy(base.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    return ordered.withColumn("_p", base).join(F.broadcast(starts), "_p").withColumn("scan_pos", F.col("_s") + F.col("_m") - F.shiftleft("_p", 33)).drop("_p", "_s", "_m")


def repulsion(vec: str, shadows: list[list[float]], sigma: float = 0.3, weight: float = 0.5) -> Column:
    """Penalty of rows near vectors shown or rejected before: weight times a sum of Gaussians."""
    total = F.lit(0.0)
    for s in shadows:
        total = total + F.exp(-V.l2_squared(F.col(vec), V.lit_vector(s)) / F.lit(2 * sigma * sigma))
    return F.lit(float(weight)) * total


def knn_join(left: DataFrame, left_id: str, right: DataFrame, right_id: str, vec: str, k: int, block: int = 4096, part: int = 50_000) -> DataFrame:
    """(left_id, right_id, distance, rank): for every left row its k nearest right rows by cosine.

    `left` is a stated query set. It is cut into blocks of rows by hash; every block meets
    every part of `right` once in a matrix product whose task keeps k candidates per query,
    and the candidates are merged per query.
    """
    blocks = max(1, -(-left.count() // block))
    q = left.select(F.col(left_id).cast("string").alias("q"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(left_id), F.lit(blocks)).alias("b"))
    r = right.select(F.col(right_id).alias("r"), F.col(vec).cast("array<double>").alias("v"))
    # a part has at most `part` rows, however many there are in all
    parts = max(right.sparkSession.sparkContext.defaultParallelism, -(-right.count() // part))
    r = r.withColumn("p", F.pmod(F.xxhash64("r"), F.lit(parts))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    q = q.withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    rtype = right.schema[right_id].dataType.simpleString()

    def best(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "r": [], "distance": []})
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        x, y = x / np.where(nx > 0, nx, 1)[:, None], y / np.where(ny > 0, ny, 1)[:, None]
        ids, out = b["r"].to_numpy(), []
        order = np.argsort(ids, kind="stable")
        y, ids = y[order], ids[order]
        for s in range(0, len(x), 256):
            d = 1 - x[s:s + 256] @ y.T
            m = min(k, d.shape[1])
            # all that tie with the last one are looked at, so the first ids win
            last = np.partition(d, m - 1, axis=1)[:, m - 1]
            row, col = np.nonzero(d <= last[:, None])
            by = np.lexsort((col, d[row, col], row))
            row, col = row[by], col[by]
            top = col[np.searchsorted(row, np.arange(len(d)))[:, None] + np.arange(m)]
            out.append(pd.DataFrame({"q": np.repeat(a["q"].to_numpy()[s:s + 256], top.shape[1]), "r": ids[top].ravel(), "distance": np.take_along_axis(d, top, axis=1).ravel()}))
        return pd.concat(out)

    found = q.groupBy("b", "p").cogroup(r.groupBy("b", "p")).applyInPandas(best, f"q string, r {rtype}, distance double")
    by = Window.partitionBy("q").orderBy(F.round("distance", 12), "r")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").cast(left.schema[left_id].dataType).alias(left_id), F.col("r").alias("neighbor_id"), "distance", "rank")


def mmr(df: DataFrame, id: str, vec: str, query: list[float], k: int, lam: float = 0.5, pool: int | None = None) -> DataFrame:
    """(id, rank, relevance): k rows picked one by one for relevance to the query and distance from those picked.

    Each pick is the row with the greatest lam * similarity - (1 - lam) * greatest
    similarity to a pick, ties by id. Rows without a vector are never picked; of rows with
    the same id at most one is.

    The choice is made among all rows. From the second pick on no row's score can rise, so
    a pass over the table that keeps the `pool` (20 k) rows of the greatest scores also
    bounds those of all others: picks are made among the kept rows as long as the best is
    above that bound, and then the next pass follows. Passes run when this is called.
    """
    m = max(1, pool or 20 * k)
    sim = F.lit(1.0) - V.cosine_distance_to(F.col(vec), query)
    kind = df.schema[id].dataType.simpleString()
    schema = f"id {kind}, v array<double>, rel double, score double"
    rows = materialize(df.where(F.col(vec).isNotNull()).select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("v"), sim.alias("rel")), "mmr")

    def units(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy())
        n = np.linalg.norm(x, axis=1)
        return x / np.where(n > 0, n, 1)[:, None]

    picks, relevance, seen = [], [], np.empty((0, len(query)))

    def scores(rel: np.ndarray, worst: np.ndarray) -> np.ndarray:
        return np.round(lam * rel - (1 - lam) * worst, 12)

    def best(most: int) -> pd.DataFrame:
        """The `most` rows of the greatest scores given the picks so far, greatest first."""
        def run(it: Iterator[pd.DataFrame], seen: np.ndarray = seen, taken: frozenset = frozenset(picks)) -> Iterator[pd.DataFrame]:
            kept = None
            for pdf in it:
                pdf = pdf[~pdf["id"].isin(taken)]
                if len(pdf):
                    worst = (units(pdf["v"]) @ seen.T).max(axis=1) if len(seen) else np.zeros(len(pdf))
                    pdf = pdf.assign(score=scores(pdf["rel"].to_numpy(), worst))
                    kept = (pdf if kept is None else pd.concat([kept, pdf])).sort_values(["score", "id"], ascending=[False, True]).head(most)
            if kept is not None:
                yield kept

        return rows.mapInPandas(run, schema).orderBy(F.desc("score"), "id").limit(most).toPandas()

    while len(picks) < k:
        most = m if picks else 1  # similarities to the first pick may be negative, so bounds hold only after it
        pdf = best(most)
        if not len(pdf):
            break
        bound = pdf["score"].iloc[-1] if len(pdf) == most else -np.inf
        pdf = pdf.drop_duplicates("id").sort_values("id").reset_index(drop=True)
        x, rel = units(pdf["v"]), pdf["rel"].to_numpy()
        s, free, first = pdf["score"].to_numpy().copy(), np.ones(len(pdf), dtype=bool), True
        worst = (x @ seen.T).max(axis=1) if len(seen) else np.full(len(x), -1.0)
        while len(picks) < k and free.any():
            at = int(np.where(free, s, -np.inf).argmax())
            if not first and not s[at] > bound:
                break
            first, free[at] = False, False
            picks.append(pdf["id"].iloc[at])
            relevance.append(float(rel[at]))
            seen = np.vstack([seen, x[at]])
            worst = np.maximum(worst, x @ x[at])
            s = scores(rel, worst)
    found = [(p.item() if hasattr(p, "item") else p, r, s) for r, (p, s) in enumerate(zip(picks, relevance), 1)]
    return df.sparkSession.createDataFrame(found, f"id {kind}, rank int, relevance double").withColumnRenamed("id", id)


def mmr_groups(df: DataFrame, id: str, group: str, vec: str, query: list[float], k: int, lam: float = 0.5) -> DataFrame:
    """(group, id, rank, relevance): the diverse choice of `mmr` in every group of rows at once.

    Each round is a partial aggregation over all rows, which are joined with the picks of
    their group so far; no group is gathered in a task. Groups of fewer than k rows give all
    of them; rows without a vector or a group are never picked, of repeated ids at most one is.
    """
    rows = df.where(F.col(vec).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(id).alias("i"), F.col(vec).cast("array<double>").alias("v"))
    rows = materialize(rows.withColumn("rel", F.lit(1.0) - V.cosine_distance_to(F.col("v"), query)), "mmr-rows")
    picks = None
    for rank in range(1, k + 1):
        if picks is None:
            left, worst = rows, F.lit(0.0)
        else:
            left = join_sized(rows, picks, ["g"]).where(~F.array_contains(F.transform("picks", lambda p: p["i"]), F.col("i")))
            worst = F.array_max(F.transform("picks", lambda p: V.cosine_similarity(F.col("v"), p["v"])))
        score = F.round(F.lit(lam) * F.col("rel") - F.lit(1 - lam) * worst, 12)
        best = left.groupBy("g").agg(F.min_by(F.struct("i", "v", "rel"), F.struct((-score).alias("s"), F.col("i"))).alias("best")).select("g", F.array("best").alias("new"))
        if picks is None:
            found = best.select("g", F.col("new").alias("picks"))
        else:
            found = picks.join(best, "g", "left").select("g", F.concat("picks", F.coalesce("new", F.slice("picks", 1, 0))).alias("picks"))
        picks = materialize(found, "mmr-picks")
    out = picks.select("g", F.posexplode("picks").alias("pos", "p"))
    return out.select(F.col("g").alias(group), F.col("p.i").alias(id), (F.col("pos") + 1).alias("rank"), F.col("p.rel").alias("relevance"))


def fetch_rows(df: DataFrame, id: str, hits: DataFrame, drop: list[str]) -> DataFrame:
    """The rows of the hits (a bounded top-k), without the columns `drop`."""
    return df.drop(*drop).join(F.broadcast(hits), id)


def store_features(store: DataFrame | None, new: DataFrame, actor: str, force: bool = False) -> DataFrame:
    """Upsert of (doc_id, features) rows by `actor`: rows of another owner stay unless forced.

    Returns the new state (doc_id, features, created_by, updated_by); the last of repeated new rows by position wins.
    """
    if store is None:
        return new.select("doc_id", "features", F.lit(actor).alias("created_by"), F.lit(actor).alias("updated_by"))
    n = new.select("doc_id", F.col("features").alias("nf"))
    j = store.join(n, "doc_id", "full_outer")
    take = F.col("nf").isNotNull() & (F.col("created_by").isNull() | (F.col("created_by") == actor) | F.lit(force))
    return j.select("doc_id", F.when(take, F.col("nf")).otherwise(F.col("features")).alias("features"),
                    F.coalesce("created_by", F.lit(actor)).alias("created_by"), F.when(take, F.lit(actor)).otherwise(F.col("updated_by")).alias("updated_by"))


def topology_negatives(store: DataFrame, surrogate: list[float], k: int) -> DataFrame:
    """(doc_id, distance): the k stored rows nearest by Euclidean distance; rows of another length are skipped."""
    return knn(store.where(F.size("features") == len(surrogate)), "doc_id", "features", surrogate, k, "l2")
