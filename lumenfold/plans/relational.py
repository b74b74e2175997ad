"""The relational surface over the star schema: joins, aggregates, windows, set operations, JSON, strings, dates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.operators import rewrite as R
from lumenfold.runtime import shared_dir
from lumenfold.sources import formats
from lumenfold.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def views(spark: SparkSession, folder: str) -> None:
    for t in TABLES:
        table(spark, folder, t).createOrReplaceTempView(t)


def _same(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query whose text Spark and the checking engine both understand."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        views(spark, folder)
        return spark.sql(spark_sql or sql)

    QUERIES[name], SQL[name] = run, sql


def _frame(name: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = (lambda spark, folder: build(lambda t: table(spark, folder, t))), sql


MONEY = "CAST(round({} * 100) AS BIGINT)"
_LC = MONEY.format("l_extendedprice")
_OC = MONEY.format("o_totalprice")
_EC = MONEY.format("value")

# ---- projection, filter, predicates
_same("project_filter", "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
_same("filter_in_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 10 AND NOT (l_tax > 0.04 OR l_discount = 0)")
_same("filter_nulls", "SELECT count(*) AS n, count(lang) AS langs, CAST(sum(CASE WHEN kit IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_kit FROM documents WHERE source IS NOT NULL")
_same("case_coalesce", "SELECT doc_id, coalesce(lang, 'none') AS lang, CASE WHEN n_chars IS NULL THEN 'null' WHEN n_chars < 100 THEN 'short' ELSE 'long' END AS size FROM documents")
_same("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_same("like_filter", "SELECT c_custkey FROM customer WHERE c_name LIKE '%0_'")
_same("scalar_subquery", f"SELECT o_orderkey FROM orders WHERE {_OC} > (SELECT avg({_OC}) FROM orders)")
_same("correlated_scalar", f"SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
_same("correlated_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
_same("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")

# ---- joins
_same("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_same("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
_same("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
_same("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey")
_same("join_semi", "SELECT s_suppkey FROM supplier SEMI JOIN lineitem ON s_suppkey = l_suppkey")
_same("join_anti", "SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey")
_same("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
_same("join_star", f"""SELECT n_name, CAST(sum({_LC}) AS BIGINT) AS cents, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
_same("join_lateral_json", "SELECT event_id, k FROM events, LATERAL (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k) WHERE k > 90",
      "SELECT event_id, k FROM events, LATERAL (SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k) WHERE k > 90")


def _range_join(t: Callable[[str], DataFrame]) -> DataFrame:
    """Events within the minute after each error of the same user: bucketed on the minute, so it is an equi-join."""
    e = t("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    minute = 60_000_000
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("us").alias("e_us"), F.explode(F.array(F.floor(F.col("us") / minute), F.floor(F.col("us") / minute) + 1)).alias("bucket"))
    b = e.withColumn("bucket", F.floor(F.col("us") / minute))
    return a.join(b, ["user_id", "bucket"]).where("us > e_us and us <= e_us + 60000000").select("error_id", "event_id")


_frame("join_range", _range_join, "SELECT a.event_id AS error_id, b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 MINUTE WHERE a.event_type = 'error'")


def _asof_join(t: Callable[[str], DataFrame]) -> DataFrame:
    """The last signup of the same user before each purchase: one union and one window instead of a range join."""
    e = t("events")
    a = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.lit(None).cast("bigint").alias("signup_id"), F.lit(1).alias("side"))
    b = e.where("event_type = 'signup'").select("user_id", "ts", F.lit(None).cast("bigint").alias("event_id"), F.col("event_id").alias("signup_id"), F.lit(0).alias("side"))
    w = Window.partitionBy("user_id").orderBy("ts", "side", "signup_id").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("signup_id", F.last("signup_id", ignorenulls=True).over(w)).where("side = 1").select("event_id", "signup_id")


_frame("join_asof", _asof_join, """SELECT a.event_id, b.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id AND a.ts >= b.ts""")


def _nearest_centroid(t: Callable[[str], DataFrame]) -> DataFrame:
    """Each part's nearest of the regions' keys by size: a theta join with a table of fixed size, and argmin."""
    p, r = t("part").select("p_partkey", "p_size"), t("region").select("r_regionkey")
    d = F.abs(F.col("p_size") - F.col("r_regionkey") * 10)
    return p.crossJoin(F.broadcast(r)).groupBy("p_partkey").agg(F.min_by("r_regionkey", F.struct(d, "r_regionkey")).alias("nearest"))


_frame("join_theta_argmin", _nearest_centroid, """SELECT p_partkey, nearest FROM (SELECT p_partkey, r_regionkey AS nearest, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size - r_regionkey * 10), r_regionkey) AS rn
  FROM part, region) WHERE rn = 1""")

# ---- aggregation
_same("agg_basic", f"""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({_LC}) AS BIGINT) AS cents, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean
  FROM lineitem WHERE l_shipdate <= DATE '2001-09-01' GROUP BY l_returnflag, l_linestatus""")
_same("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
_same("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 20) AS big, count(*) AS n FROM events GROUP BY event_type")
_same("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_same("agg_variance", "SELECT event_type, round(var_pop(value), 4) AS v, round(stddev_samp(value), 4) AS sd FROM events GROUP BY event_type")
_same("agg_conditional_max", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS best_f FROM orders GROUP BY o_custkey")
_same("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_same("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_same("rollup", "SELECT n_regionkey, c_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)")
_same("latest_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1")
_frame("latest_max_by", lambda t: t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")),
       "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
_frame("ordered_collect", lambda t: t("lineitem").groupBy("l_orderkey").agg(
    F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("parts")),
    "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
_frame("json_array_agg", lambda t: t("nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("names")),
       "SELECT n_regionkey, to_json(list(n_name ORDER BY n_name))::VARCHAR AS names FROM nation GROUP BY n_regionkey")
_frame("json_object_agg", lambda t: t("nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))))).alias("keys")),
       "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys FROM nation GROUP BY n_regionkey")
_frame("pivot", lambda t: t("events").groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.count(F.lit(1))).na.fill(0),
       "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id")

_frame("agg_approx", lambda t: t("orders").groupBy("o_orderpriority").agg(
    (F.abs(F.approx_count_distinct("o_custkey", 0.02) / F.countDistinct("o_custkey") - 1) < 0.1).alias("distinct_close"),
    F.percentile_approx("o_totalprice", 0.5, 10000).between(F.percentile("o_totalprice", 0.48), F.percentile("o_totalprice", 0.52)).alias("median_close")),
    "SELECT o_orderpriority, true AS distinct_close, true AS median_close FROM orders GROUP BY o_orderpriority")
_frame("join_json_key", lambda t: t("nation").select("n_name", F.to_json(F.struct(F.col("n_nationkey").alias("k"))).alias("j")).alias("x").join(
    t("customer"), F.get_json_object("x.j", "$.k").cast("int") == F.col("c_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")),
    "SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")


def _saved(t) -> DataFrame:
    """A table made by a query, to which the rows of another are appended."""
    spark, path = t("nation").sparkSession, f"{shared_dir(t('nation').sparkSession)}/lumenfold/saved-{uuid.uuid4().hex}"
    name = "saved_" + uuid.uuid4().hex
    t("nation").createOrReplaceTempView(f"n_{name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS SELECT n_nationkey AS id, n_name AS name FROM n_{name} WHERE n_regionkey < 2")
    spark.sql(f"INSERT INTO {name} SELECT n_nationkey + 100, n_name FROM n_{name} WHERE n_regionkey >= 2")
    return spark.table(name)


_frame("ctas_append", _saved, "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey >= 2")

# ---- windows, order, limit, sets
_same("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
_same("win_rank_dense", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS d FROM lineitem")
_same("win_lag_lead", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events")
_same("win_running_sum", f"SELECT event_id, CAST(sum({_EC}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents FROM events")
_same("win_rows_frame", f"SELECT event_id, CAST(sum({_EC}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS cents FROM events")
_same("win_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter FROM customer")
_same("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_same("topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
_same("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_same("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_same("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")
_same("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")

# ---- generated rows, JSON, scalars
_same("recursive_sequence", "WITH RECURSIVE gs(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM gs WHERE n < 50) SELECT n, n * n AS sq FROM gs")
_frame("sequence_grid", lambda t: t("region").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r")).select("r", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("c")).where("not (r between 6 and 13 and c between 6 and 13)"),
       "SELECT r::INT AS r, c::INT AS c FROM range(0, 20) a(r), range(0, 20) b(c) WHERE NOT (r BETWEEN 6 AND 13 AND c BETWEEN 6 AND 13)")
_frame("expand_rows", lambda t: t("nation").select("n_nationkey", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_nationkey").cast("bigint") + 1)).alias("i")),
       "SELECT n_nationkey, i FROM nation, LATERAL (SELECT unnest(generate_series(1, n_nationkey + 1)) AS i)")
_same("inline_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS t(id, name)")
_frame("json_extract_props", lambda t: t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")),
       "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_frame("json_each", lambda t: t("events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value")),
       "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events")
_frame("json_valid", lambda t: t("incident_logs").select("id", (F.try_parse_json("payload").isNotNull()).alias("ok")).groupBy("ok").agg(F.countDistinct("id").alias("n")),
       "SELECT coalesce(json_valid(payload), false) AS ok, count(DISTINCT id) AS n FROM incident_logs GROUP BY ALL")
_same("string_fns", "SELECT n_nationkey, substr(n_name, 1, 3) AS head, replace(n_name, 'A', 'x') AS repl, n_name || '-' || n_regionkey AS joined, length(n_name) AS len, upper(lower(n_name)) AS up, trim('  ' || n_name || ' ') AS t FROM nation")
_frame("hex_printf", lambda t: t("nation").select("n_nationkey", F.hex(F.col("n_name")).alias("h"), F.format_string("%05d|%s", F.col("n_nationkey").cast("int"), F.col("n_name")).alias("p")),
       "SELECT n_nationkey, hex(n_name) AS h, printf('%05d|%s', n_nationkey::INT, n_name) AS p FROM nation")
_frame("date_fns", lambda t: t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"), F.unix_seconds(F.add_months("o_orderdate", 1).cast("timestamp")).alias("next")),
       "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y-%m-%d') AS s, epoch(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE))::BIGINT AS next FROM orders")
_frame("math_fns", lambda t: t("events").select("event_id", F.round(F.sin("value"), 6).alias("s"), F.round(F.cos("value"), 6).alias("c"), F.when(F.col("value") >= 15, F.round(F.sqrt(F.col("value") - 15), 6)).alias("r"), F.abs(F.col("value") - 10).alias("a"), F.least("value", F.lit(10.0)).alias("l"), (F.col("event_id") % 7).alias("m")),
       "SELECT event_id, round(sin(value), 6) AS s, round(cos(value), 6) AS c, CASE WHEN value >= 15 THEN round(sqrt(value - 15), 6) END AS r, abs(value - 10) AS a, least(value, 10.0::DOUBLE) AS l, event_id % 7 AS m FROM events")
_frame("cast_try", lambda t: t("events").select("event_id", F.col("value").cast("bigint").alias("i"), F.expr("try_cast(event_type AS int)").alias("bad"), F.col("event_id").cast("string").alias("s")),
       "SELECT event_id, trunc(value)::BIGINT AS i, TRY_CAST(event_type AS INT) AS bad, event_id::VARCHAR AS s FROM events")
_frame("crypto_sha256", lambda t: t("nation").select("n_nationkey", F.sha2(F.col("n_name").cast("binary"), 256).alias("h")), "SELECT n_nationkey, sha256(n_name) AS h FROM nation")


def _limited(t: Callable[[str], DataFrame]) -> DataFrame:
    """A result cut at a limit, with the flag whether there was more."""
    rows = t("orders").orderBy("o_orderkey").limit(101)
    n = rows.agg((F.count(F.lit(1)) > 100).alias("truncated"))
    return rows.limit(100).select("o_orderkey").crossJoin(F.broadcast(n))


_frame("rowset_limit", _limited, "SELECT o_orderkey, (SELECT count(*) > 100 FROM orders) AS truncated FROM orders ORDER BY o_orderkey LIMIT 100")

# ---- batch forms of event-time windows
_frame("tumbling_count", lambda t: t("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n"),
       "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
_frame("sliding_avg", lambda t: t("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes").alias("w")).agg(F.round(F.sum(F.round(F.col("value") * 100).cast("bigint")) / F.count(F.lit(1)), 4).alias("mean")).select(F.unix_seconds("w.start").alias("start"), "mean"),
       """SELECT s AS start, round(sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*), 4) AS mean FROM (SELECT value, unnest([(floor(epoch(ts) / 1800) * 1800)::BIGINT, (floor(epoch(ts) / 1800) * 1800)::BIGINT - 1800]) AS s FROM events) GROUP BY s""")


def _sessions(t: Callable[[str], DataFrame]) -> DataFrame:
    s = t("events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


_frame("session_users", _sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""")


# ---- files and rewrites of tables
def _round_trip(fmt: str, by: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
        path = f"{shared_dir(spark)}/lumenfold/{fmt}-{uuid.uuid4().hex}"
        formats.write(df, path, fmt, by)
        return formats.read(spark, path, df.schema, fmt).where("c_nationkey = 3")

    return run


for _fmt in formats.FORMATS:
    QUERIES[f"io_{_fmt}"] = _round_trip(_fmt)
    SQL[f"io_{_fmt}"] = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 3"
QUERIES["io_partitioned"], SQL["io_partitioned"] = _round_trip("parquet", ["c_nationkey"]), SQL["io_parquet"]


def _changed(t: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Suppliers as the target; customers' keys and balances as the incoming rows."""
    return (t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")))


_OLD, _NEW = "(SELECT s_suppkey AS k, s_acctbal AS v FROM supplier)", "(SELECT c_custkey AS k, c_acctbal AS v FROM customer)"
_frame("insert_conflict_nothing", lambda t: R.insert_new(*_changed(t), ["k"]), f"SELECT k, v FROM {_OLD} UNION ALL SELECT k, v FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.k = n.k)")
_frame("upsert", lambda t: R.upsert(*_changed(t), ["k"]), f"SELECT k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v FROM {_OLD} o FULL JOIN {_NEW} n USING (k)")
_frame("upsert_guarded", lambda t: R.upsert(*_changed(t), ["k"], F.col("new_v") > F.col("v")), f"SELECT k, CASE WHEN o.k IS NULL OR n.v > o.v THEN n.v ELSE o.v END AS v FROM {_OLD} o FULL JOIN {_NEW} n USING (k)")
_frame("update_where", lambda t: R.update_where(_changed(t)[0], F.col("v") < 0, v=F.lit(0.0)), f"SELECT k, CASE WHEN v < 0 THEN 0.0::DOUBLE ELSE v END AS v FROM {_OLD}")
_frame("delete_where", lambda t: R.delete_where(_changed(t)[0], F.col("v") < 0), f"SELECT k, v FROM {_OLD} WHERE NOT (v < 0)")
