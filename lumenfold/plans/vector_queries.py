"""Vector functions and searches over the embeddings table, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import udfs as U
from lumenfold.functions import vector as V
from lumenfold.operators import search as S
from lumenfold.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def E() -> Column:  # noqa: N802
    return F.col("embedding")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")


def query_vector(spark: SparkSession, folder: str, id: int = 0) -> list[float]:
    return S.vector_of(embeddings(spark, folder), "vec_id", "embedding", id)


def _r(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


WITH_Q = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, q FROM embeddings, q)
"""
_NE, _NQ = "sqrt(list_dot_product(e, e))", "sqrt(list_dot_product(q, q))"
COS = f"(1 - list_dot_product(e, q) / ({_NE} * {_NQ}))"
L2 = "sqrt(list_sum(list_transform(list_zip(e, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


def _lp(p: float) -> str:
    return f"pow(list_sum(list_transform(list_zip(e, q), lambda x: pow(abs(x[1] - x[2]), {p}))), {1 / p!r})"


def _norm_of(f: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip(e, q), lambda x: ({f}) * ({f}))))"


def _add(name: str, spark_value: Callable[[Column], Column], sql_value: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        q = V.lit_vector(query_vector(spark, folder))
        return embeddings(spark, folder).select("vec_id", spark_value(q).alias("value"))

    QUERIES[name] = run
    SQL[name] = WITH_Q + f"SELECT vec_id, {sql_value} AS value FROM e"


for _name, _spark, _sql in (
    ("vec_l2", lambda q: V.l2_distance(E(), q), L2),
    ("vec_l2sq", lambda q: V.l2_squared(E(), q), L2.removeprefix("sqrt")),
    ("vec_cosine_dist", lambda q: V.cosine_distance(E(), q), COS),
    ("vec_cosine_sim", lambda q: V.cosine_similarity(E(), q), f"1 - {COS}"),
    ("sniper_distance", lambda q: V.cosine_distance(E(), q), COS),
    ("vec_neg_ip", lambda q: V.negative_inner_product(E(), q), "-list_dot_product(e, q)"),
    ("vec_lp_05", lambda q: V.lp_distance(E(), q, 0.5), _lp(0.5)),
    ("vec_lp_3", lambda q: V.lp_distance(E(), q, 3.0), _lp(3.0)),
    ("vec_norm", lambda q: V.norm(E()), _NE),
    ("vec_add_norm", lambda q: V.norm(V.add(E(), q)), _norm_of("x[1] + x[2]")),
    ("vec_sub_norm", lambda q: V.norm(V.sub(E(), q)), _norm_of("x[1] - x[2]")),
    ("vec_scale_norm", lambda q: V.norm(V.scale(E(), 2.5)), f"2.5 * {_NE}"),
    ("vec_normalize_check", lambda q: V.norm(V.normalize(V.scale(E(), 7.0))), f"{_NE} / {_NE}"),
    ("vec_int8_scale", lambda q: V.quantize_int8(E())["scale"], "list_max(list_transform(e, lambda x: abs(x))) / 127.0::DOUBLE"),
    ("vec_weighted_concat", lambda q: V.norm(V.weighted_concat(E(), q, 0.25)), f"sqrt(0.0625 * list_dot_product(e, e) + 0.5625 * list_dot_product(q, q))"),
):
    _add(_name, (lambda q, f=_spark: _r(f(q))), f"round({_sql}, 6) + 0.0")
_add("vec_dims", lambda q: V.dims(E()), "len(e)::INT")
_add("vec_int8_codes", lambda q: F.aggregate(V.quantize_int8(E())["codes"], F.lit(0), lambda s, x: s + x.cast("int")),
     "list_sum(list_transform(e, lambda x: (sign(x) * floor(abs(x) / (list_max(list_transform(e, lambda y: abs(y))) / 127.0::DOUBLE) + 0.5))::INT))::INT")
_add("vec_binary_bits", lambda q: V.binary_text(E()), "list_aggregate(list_transform(e, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), 'string_agg', '')")
_add("vec_hamming", lambda q: V.hamming_distance(V.quantize_binary(E()), V.quantize_binary(q)),
     "list_sum(list_transform(list_zip(e, q), lambda x: CASE WHEN (x[1] >= 0) <> (x[2] >= 0) THEN 1 ELSE 0 END))::INT")
_add("vec_text_roundtrip", lambda q: _r(V.norm(V.from_text(V.to_json(E())))), f"round({_NE}, 6) + 0.0")
_add("vec_packed_roundtrip", lambda q: _r(V.norm(U.decode_packed(U.encode_packed(E())))), f"round({_NE}, 6) + 0.0")


def vec_zeros(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(1, 5).select(F.col("id"), F.size(V.zeros(7)).alias("dims"), V.norm(V.zeros(7)).alias("norm"))


QUERIES["vec_zeros"] = vec_zeros
SQL["vec_zeros"] = "SELECT range AS id, 7 AS dims, 0.0::DOUBLE AS norm FROM range(1, 5)"


# ---- searches -------------------------------------------------------------------------------

def _top(df: DataFrame) -> DataFrame:
    return df.select("vec_id", _r(F.col("distance")).alias("distance"))


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _top(S.knn(embeddings(spark, folder), "vec_id", "embedding", query_vector(spark, folder), 10))


def knn_l2_top1(spark: SparkSession, folder: str) -> DataFrame:
    return _top(S.knn(embeddings(spark, folder).where("vec_id <> 0"), "vec_id", "embedding", query_vector(spark, folder), 1, "l2"))


def knn_join(spark: SparkSession, folder: str) -> DataFrame:
    e = embeddings(spark, folder)
    return S.knn_join(e.where("vec_id % 50 = 0"), "vec_id", e, "vec_id", "embedding", 5).select("vec_id", "neighbor_id", _r(F.col("distance")).alias("distance"), "rank")


def hybrid_cohort_knn(spark: SparkSession, folder: str) -> DataFrame:
    e = embeddings(spark, folder)
    return _top(S.hybrid_knn(e, "vec_id", "embedding", query_vector(spark, folder), e.where("label = 3").select("vec_id"), 5))


def hybrid_scan_pos(spark: SparkSession, folder: str) -> DataFrame:
    cohort = S.with_scan_position(embeddings(spark, folder).where("label = 3"), "vec_id")
    hits = S.knn(cohort, "vec_id", "embedding", query_vector(spark, folder), 5)
    return cohort.join(F.broadcast(hits), "vec_id").select("vec_id", "scan_pos", _r(F.col("distance")).alias("distance"))


def trajectory_knn(spark: SparkSession, folder: str) -> DataFrame:
    return _top(S.trajectory_knn(embeddings(spark, folder), "vec_id", "embedding", query_vector(spark, folder, 0), query_vector(spark, folder, 1), 5))


def cross_modal_knn(spark: SparkSession, folder: str) -> DataFrame:
    q = query_vector(spark, folder)
    return _top(S.cross_modal_knn(embeddings(spark, folder), "vec_id", "embedding", q[:32], q[32:], 0.3, 5))


def feature_negatives_l2(spark: SparkSession, folder: str) -> DataFrame:
    new = embeddings(spark, folder).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("features"))
    store = S.store_features(S.store_features(None, new, "a"), new.withColumn("features", F.transform("features", lambda x: x * 0)), "b")
    return S.topology_negatives(store, query_vector(spark, folder), 6).select("doc_id", _r(F.col("distance")).alias("distance"))


def hamming_prefilter_rerank(spark: SparkSession, folder: str) -> DataFrame:
    q = V.lit_vector(query_vector(spark, folder))
    h = V.hamming_distance(V.quantize_binary(E()), V.quantize_binary(q))
    near = embeddings(spark, folder).select("vec_id", "embedding", h.alias("h")).orderBy("h", "vec_id").limit(100)
    return _top(S.knn(near, "vec_id", "embedding", query_vector(spark, folder), 10))


def knn_repulsed(spark: SparkSession, folder: str) -> DataFrame:
    shadows = [query_vector(spark, folder, 0), query_vector(spark, folder, 1)]
    return _top(S.knn(embeddings(spark, folder), "vec_id", "embedding", query_vector(spark, folder), 10, penalty=S.repulsion("embedding", shadows)))


def fetch_hits(spark: SparkSession, folder: str) -> DataFrame:
    e = embeddings(spark, folder)
    return S.fetch_rows(e, "vec_id", _top(S.knn(e, "vec_id", "embedding", query_vector(spark, folder), 10)), ["embedding"])


def scout_mmr(spark: SparkSession, folder: str) -> DataFrame:
    return S.mmr(embeddings(spark, folder), "vec_id", "embedding", query_vector(spark, folder), 12, 0.5, 200).select("vec_id", "rank", _r(F.col("relevance")).alias("relevance"))


def scout_label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    e = embeddings(spark, folder)
    picks = S.mmr(e, "vec_id", "embedding", query_vector(spark, folder), 50, 0.2)
    return picks.join(e.select("vec_id", "label"), "vec_id").agg(F.count(F.lit(1)).alias("picks"), F.countDistinct("label").alias("labels"))


def scout_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The diverse choice as an aggregate: four rows of every label."""
    picks = S.mmr_groups(embeddings(spark, folder), "vec_id", "label", "embedding", query_vector(spark, folder), 4, 0.5)
    return picks.select("label", "vec_id", "rank", _r(F.col("relevance")).alias("relevance"))


def search_debug(spark: SparkSession, folder: str) -> DataFrame:
    one = embeddings(spark, folder).select("vec_id", E().cast("array<double>").alias("v"))
    r = U.array_function("search_debug")(F.col("v"), F.lit(20), F.lit(30))
    return one.select("vec_id", r.alias("r")).select("vec_id", "r.dim", "r.generations", "r.population_size", F.round("r.best_fit", 6).alias("best_fit"))


def mmr_sql(k: int, lam: float, shown: str) -> str:
    """Greedy choice pick by pick: a subquery for each, which scores all rows against those picked before."""
    steps = [WITH_Q + ", c AS MATERIALIZED (SELECT vec_id, e, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS rel FROM e)"]
    for r in range(1, k + 1):
        if r == 1:
            steps.append(f"p1 AS MATERIALIZED (SELECT vec_id, e, rel AS relevance, 1 AS rank FROM c ORDER BY round({lam} * rel, 12) DESC, vec_id LIMIT 1)")
        else:
            steps.append(f"""n{r} AS (SELECT c.vec_id, any_value(c.e) AS e, any_value(c.rel) AS relevance, {r} AS rank, round({lam} * any_value(c.rel) - (1 - {lam}) * max(
              list_dot_product(c.e, p.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(p.e, p.e)))), 12) AS score
              FROM c, p{r - 1} p WHERE c.vec_id NOT IN (SELECT vec_id FROM p{r - 1}) GROUP BY c.vec_id ORDER BY score DESC, c.vec_id LIMIT 1),
              p{r} AS MATERIALIZED (SELECT * FROM p{r - 1} UNION ALL SELECT vec_id, e, relevance, rank FROM n{r})""")
    return ", ".join(steps) + f" SELECT {shown} FROM p{k}"


def _knn_sql(distance: str, k: int, where: str = "", by: str = "vec_id") -> str:
    return WITH_Q + f"SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {distance} AS d FROM e {where}) ORDER BY d, {by} LIMIT {k}"


QUERIES |= {f.__name__: f for f in (knn_cosine, knn_l2_top1, knn_join, hybrid_cohort_knn, hybrid_scan_pos, trajectory_knn, cross_modal_knn, feature_negatives_l2,
                                    hamming_prefilter_rerank, knn_repulsed, fetch_hits, scout_mmr, scout_label_coverage, scout_groups, search_debug)}
_DELTA = """WITH q AS (SELECT list_transform(list_zip(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), lambda x: x[1] - x[2]) AS q
  FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1), e AS (SELECT vec_id, embedding::DOUBLE[] AS e, q FROM embeddings, q)
"""
_CROSS = """WITH q AS (SELECT list_concat(list_transform((embedding::DOUBLE[])[1:32], lambda x: x * 0.3), list_transform((embedding::DOUBLE[])[33:64], lambda x: x * 0.7)) AS q
  FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS e, q FROM embeddings, q)
"""
SQL |= {
    "knn_cosine": _knn_sql(COS, 10),
    "knn_l2_top1": _knn_sql(L2, 1, "WHERE vec_id <> 0"),
    "knn_join": f"""WITH p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
        (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS d
        FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), neighbor_id)::INT AS rank FROM p)
        SELECT vec_id, neighbor_id, round(d, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 5""",
    "hybrid_cohort_knn": _knn_sql(COS, 5, "WHERE label = 3"),
    "hybrid_scan_pos": WITH_Q + f"""SELECT vec_id, scan_pos, round(d, 6) + 0.0 AS distance FROM
        (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS scan_pos, {COS} AS d FROM e WHERE label = 3) ORDER BY d, vec_id LIMIT 5""",
    "trajectory_knn": _DELTA + f"SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {COS} AS d FROM e) ORDER BY d, vec_id LIMIT 5",
    "cross_modal_knn": _CROSS + f"SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {COS} AS d FROM e) ORDER BY d, vec_id LIMIT 5",
    "feature_negatives_l2": WITH_Q + f"SELECT vec_id AS doc_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {L2} AS d FROM e) ORDER BY d, vec_id LIMIT 6",
    "hamming_prefilter_rerank": WITH_Q + f""", h AS (SELECT *, list_sum(list_transform(list_zip(e, q), lambda x: CASE WHEN (x[1] >= 0) <> (x[2] >= 0) THEN 1 ELSE 0 END)) AS h FROM e ORDER BY h, vec_id LIMIT 100)
        SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {COS} AS d FROM h) ORDER BY d, vec_id LIMIT 10""".replace("\n, h AS", ", h AS"),
    "knn_repulsed": WITH_Q + f""", s AS (SELECT embedding::DOUBLE[] AS s FROM embeddings WHERE vec_id IN (0, 1)),
        d AS (SELECT vec_id, any_value({COS}) + 0.5 * sum(exp(-list_sum(list_transform(list_zip(e, s), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / 0.18)) AS d FROM e, s GROUP BY vec_id)
        SELECT vec_id, round(d, 6) + 0.0 AS distance FROM d ORDER BY d.d, vec_id LIMIT 10""",
    "fetch_hits": WITH_Q + f"SELECT vec_id, label, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, label, {COS} AS d FROM e) ORDER BY d, vec_id LIMIT 10",
}
SQL["scout_mmr"] = mmr_sql(12, 0.5, "vec_id, rank, round(relevance, 6) + 0.0 AS relevance")
SQL["scout_label_coverage"] = mmr_sql(50, 0.2, "count(*) AS picks, count(DISTINCT label) AS labels") + " JOIN embeddings USING (vec_id)"


def _groups_sql(k: int, lam: float) -> str:
    sim = "list_dot_product(c.e, p.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(p.e, p.e)))"
    steps = [WITH_Q + ", c AS MATERIALIZED (SELECT label, vec_id, e, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS rel FROM e)",
             f"p1 AS MATERIALIZED (SELECT label, vec_id, e, rel, 1 AS rank FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY round({lam} * rel, 12) DESC, vec_id) = 1)"]
    for r in range(2, k + 1):
        steps.append(f"""n{r} AS (SELECT c.label, c.vec_id, any_value(c.e) AS e, any_value(c.rel) AS rel, round({lam} * any_value(c.rel) - (1 - {lam}) * max({sim}), 12) AS score
          FROM c JOIN p{r - 1} p USING (label) WHERE c.vec_id NOT IN (SELECT vec_id FROM p{r - 1}) GROUP BY c.label, c.vec_id),
          p{r} AS MATERIALIZED (SELECT * FROM p{r - 1} UNION ALL SELECT label, vec_id, e, rel, {r} FROM n{r} QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1)""")
    return ", ".join(steps) + f" SELECT label, vec_id, rank, round(rel, 6) + 0.0 AS relevance FROM p{k}"


SQL["scout_groups"] = _groups_sql(4, 0.5)
