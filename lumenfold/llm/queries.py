"""Queries of the problems on training corpora, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.clusters import CellClusters
from lumenfold.llm.diverse import tidy_kind, varied_subset
from lumenfold.llm.garble import garbled_texts
from lumenfold.llm.neighbors import most_similar, mutual_pairs
from lumenfold.llm.packing import pack_documents, packing_report
from lumenfold.llm.tokens import encode, round_trip
from lumenfold.sources.tables import table

TOKENIZER = "byte_bpe_50k"
#: table, key, vector column, length of a usable vector
VECTOR_TABLES = (("arr_offers", "id", "vec", 4), ("docs_fv_text", "id", "embedding", 32), ("agent_capabilities", "capability_name", "embedding", 16))
#: table, id, kind, vector column, length
PICK_TABLES = {"arr_offers": ("id", "kind", "vec", 4), "imd_entities": ("id", "category", "vec", 4)}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [mutual_pairs(most_similar(table(spark, folder, t), key, vec, dim, 5, 0.95)).select(F.lit(t).alias("src"), "key_a", "key_b") for t, key, vec, dim in VECTOR_TABLES]
    return reduce(DataFrame.unionByName, parts)


def p1_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    parts = [most_similar(table(spark, folder, t), key, vec, dim, 5).select(F.lit(t).alias("src"), "key", "neighbor", F.round("similarity", 9).alias("similarity"), "rank") for t, key, vec, dim in VECTOR_TABLES]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return CellClusters(table(spark, folder, "vbg_cells"), "id", "coord").groups()


def _kinds(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster, kinds): per cluster its cell types with their counts, as JSON in the order of the names."""
    kinds = cells.select("id", tidy_kind(F.col("cell_type")).alias("kind")).dropDuplicates(["id"])
    counts = groups.join(kinds, "id").groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("kinds"))


def _described(spark: SparkSession, folder: str, pivots: bool) -> DataFrame:
    from lumenfold.llm.clusters import describe
    from lumenfold.runtime import materialize

    cells = table(spark, folder, "vbg_cells")
    found = CellClusters(cells, "id", "coord")
    members = found.members().withColumnRenamed("pivot", "cluster") if pivots else found.points.select("id", "x", "y", "z").join(found.groups().withColumnRenamed("root_id", "cluster"), "id")
    members = materialize(members.select("cluster", "id", "x", "y", "z"), "members")
    return describe(members).join(_kinds(cells, members), "cluster")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every group with its size, its most typical cells and its make-up of cell types."""
    return _described(spark, folder, False).withColumnRenamed("cluster", "root_id")


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The pivot clusters (of about one step's radius) in the same form."""
    return _described(spark, folder, True).withColumnRenamed("cluster", "pivot")


def p5_picked(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "pick_requests")
    sizes = {r["src"]: int(r["k"]) for r in requests.groupBy("src").agg(F.max("pick_size").alias("k")).collect()}
    parts = []
    for src, (id, kind, vec, dim) in PICK_TABLES.items():
        picks = varied_subset(table(spark, folder, src), id, vec, kind, dim, sizes.get(src, 0))
        asked = requests.where(F.col("src") == src)
        parts.append(picks.join(F.broadcast(asked), F.col("rank") <= F.col("pick_size")).select("request_id", "src", "pick_size", F.col("rank").cast("int"), F.col(id).alias("id"), F.col("kind"), F.round("radius", 9).alias("radius")))
    return reduce(DataFrame.unionByName, parts)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), "doc_id", "text", TOKENIZER)


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), "doc_id", "text", TOKENIZER)


def _limits(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    return [(int(r["limit_id"]), int(r["capacity_tokens"])) for r in table(spark, folder, "pack_limits").collect()]


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), "doc_id", "text", _limits(spark, folder), TOKENIZER)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(p7_packed(spark, folder), table(spark, folder, "pack_limits"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_texts(table(spark, folder, "documents"), "doc_id", "text", "source", with_text=False).select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    found = garbled_texts(table(spark, folder, "documents"), "doc_id", "text", "source")
    return found.select("doc_id", "garbled_words", "lost_words", "chains", F.round("log_odds", 6).alias("log_odds"), "restored")


QUERIES = {
    "p1_found": p1_found, "p1_neighbors": p1_neighbors, "p4_found": p4_found, "p4_groups": p4_groups, "p4_clusters": p4_clusters,
    "p5_picked": p5_picked, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_packed": p7_packed, "p7_fill": p7_fill,
    "p8_found": p8_found, "p8_restored": p8_restored,
}


def _pairs_sql(t: str, key: str, vec: str, dim: int) -> str:
    """All pairs by brute force: fit for the small tables that queries are checked on."""
    rows = f"""(SELECT k, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS u FROM (
      SELECT DISTINCT {key}::VARCHAR AS k, {vec}::DOUBLE[] AS v FROM {t} WHERE {key} IS NOT NULL AND len({vec}) = {dim}
        AND len(list_filter({vec}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({vec}, lambda x: x <> 0)) > 0))"""
    return f"""SELECT DISTINCT '{t}' AS src, least(a, b) AS key_a, greatest(a, b) AS key_b FROM (
      SELECT x.k AS a, y.k AS b, list_dot_product(x.u, y.u) AS s, row_number() OVER (PARTITION BY x.k ORDER BY list_dot_product(x.u, y.u) DESC, y.k) AS r
      FROM {rows} x JOIN {rows} y ON x.k <> y.k) WHERE r <= 5 AND s >= 0.95"""


SQL: dict[str, str] = {
    "p1_found": " UNION ALL ".join(_pairs_sql(*t) for t in VECTOR_TABLES),
    "p4_found": """WITH RECURSIVE pts AS (SELECT DISTINCT id, coord[1]::DOUBLE AS x, coord[2]::DOUBLE AS y, coord[3]::DOUBLE AS z FROM vbg_cells
        WHERE id IS NOT NULL AND len(coord) = 3 AND isfinite(coord[1]) AND isfinite(coord[2]) AND isfinite(coord[3])),
      near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id
        AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 9),
      reach AS (SELECT id, id AS root FROM pts UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.id WHERE n.b > r.root),
      label AS (SELECT id, min(root) AS root_id FROM reach GROUP BY id)
      SELECT root_id, id FROM label WHERE root_id IN (SELECT root_id FROM label GROUP BY root_id HAVING count(*) >= 5)""",
}
SQL["p4_groups"] = SQL["p4_found"].rsplit("SELECT root_id, id FROM label", 1)[0].rstrip() + """,
      g AS (SELECT root_id, id FROM label WHERE root_id IN (SELECT root_id FROM label GROUP BY root_id HAVING count(*) >= 5)),
      mean AS (SELECT root_id, count(*) AS size, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM g JOIN pts USING (id) GROUP BY root_id),
      near_mean AS (SELECT root_id, id, row_number() OVER (PARTITION BY root_id ORDER BY sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)), id) AS r FROM g JOIN pts USING (id) JOIN mean USING (root_id)),
      typical AS (SELECT root_id, list(id ORDER BY r) AS typical FROM near_mean WHERE r <= 3 GROUP BY root_id),
      kind AS (SELECT DISTINCT id, coalesce(replace(lower(trim(regexp_replace(cell_type, '[\\s_\\-]+', ' ', 'g'))), ' ', '-'), '') AS kind FROM vbg_cells),
      kinds AS (SELECT root_id, '{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}' AS kinds FROM (SELECT root_id, kind, count(*) AS n FROM g JOIN kind USING (id) GROUP BY ALL) GROUP BY root_id)
      SELECT root_id, size, typical, kinds FROM mean JOIN typical USING (root_id) JOIN kinds USING (root_id)"""
