"""Queries of the general data-preparation problems: implausible readings (p2) and rolling totals (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.rolling import rolling_totals, surges
from lumenfold.operators.spikes import Limits, SpikeSettings, score_readings
from lumenfold.sources.tables import table

#: The ranges of genuine readings.
READING_LIMITS = {
    "soh": Limits(0.5, 1.0),
    "temp_c": Limits(-45.0, 110.0),
    "volt": Limits(2.2, 4.8),
    "latency_ms": Limits(0.0, 1e6, True, True),
}
SETTINGS = SpikeSettings(READING_LIMITS)


def _readings(spark: SparkSession, folder: str, faults_only: bool) -> DataFrame:
    telemetry = score_readings(table(spark, folder, "ebl_telemetry"), "id", F.col("vin"), F.col("seq"), ["soh", "temp_c", "volt"], SETTINGS, faults_only)
    logs = score_readings(table(spark, folder, "incident_logs"), "id", F.col("agent_id"), F.unix_micros(F.col("event_ts").cast("timestamp")), ["latency_ms"], SETTINGS, faults_only)
    return telemetry.select(F.lit("ebl_telemetry").alias("src"), "*").unionByName(logs.select(F.lit("incident_logs").alias("src"), "*"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _readings(spark, folder, True).select("src", "id", "field")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Per table and field: readings, those scored as candidates, faults and the scores' spread, from the scored readings."""
    scored = _readings(spark, folder, False)
    return scored.groupBy("src", "field").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.col("score") >= SETTINGS.threshold).alias("candidates"), F.count_if("fault").alias("faults"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.avg(F.when(F.col("fault"), F.col("score"))), 6).alias("mean_fault_score"))


def p2_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The faults by rule alone: readings outside the limits, and stuck ones."""
    return _readings(spark, folder, True).where("kind in ('limit', 'stuck')").select("src", "id", "field", "kind")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return surges(rolling_totals(table(spark, folder, "cir_consumption"), "depot_id", "day", "units"), "depot_id", "day")


def p3_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return rolling_totals(table(spark, folder, "cir_consumption"), "depot_id", "day", "units")


P3_ROLLING_SQL = """
WITH bookings AS (
  SELECT DISTINCT depot_id, day, CAST(round(units * 100) AS BIGINT) AS cents FROM cir_consumption
  WHERE depot_id IS NOT NULL AND day IS NOT NULL AND units IS NOT NULL AND isfinite(units)),
daily AS (SELECT depot_id, day, CAST(sum(cents) AS BIGINT) AS cents FROM bookings GROUP BY ALL),
span AS (SELECT depot_id, min(day) AS first_day, max(day) AS last_day FROM daily GROUP BY ALL),
calendar AS (SELECT depot_id, first_day, unnest(generate_series(first_day, last_day)) AS day FROM span),
filled AS (SELECT c.depot_id, c.day, c.first_day, coalesce(d.cents, 0) AS cents FROM calendar c LEFT JOIN daily d USING (depot_id, day)),
rolled AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY depot_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS s7,
  CAST(sum(cents) OVER (PARTITION BY depot_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS s30 FROM filled)
"""

def _rules_sql(src: str, source: str, order: str, field: str, fine: str) -> str:
    return f"""SELECT '{src}' AS src, id, '{field}' AS field, CASE WHEN NOT fine THEN 'limit' ELSE 'stuck' END AS kind FROM (
      SELECT *, key IS NOT NULL AND ord IS NOT NULL AND count(*) OVER (PARTITION BY key, v, place - among) >= 8 AS stuck FROM (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, id) AS place, row_number() OVER (PARTITION BY key, v ORDER BY ord, id) AS among FROM (
          SELECT DISTINCT id, nullif(lower(regexp_replace({source}, '\\s+', '', 'g')), '') AS key, {order} AS ord, {field} AS v, {fine.format(v=field)} AS fine FROM {src} WHERE {field} IS NOT NULL)))
      WHERE stuck OR NOT fine"""


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores, "p2_rules": p2_rules, "p3_found": p3_found, "p3_rolling": p3_rolling}
SQL = {
    "p2_rules": " UNION ALL ".join([
        _rules_sql("ebl_telemetry", "vin", "seq", "soh", "{v} BETWEEN 0.5 AND 1"), _rules_sql("ebl_telemetry", "vin", "seq", "temp_c", "{v} BETWEEN -45 AND 110"),
        _rules_sql("ebl_telemetry", "vin", "seq", "volt", "{v} BETWEEN 2.2 AND 4.8"), _rules_sql("incident_logs", "agent_id", "event_ts", "latency_ms", "{v} > 0 AND {v} < 1e6")]),
    "p3_found": P3_ROLLING_SQL + "SELECT depot_id, day FROM rolled WHERE day >= first_day + 29 AND s30 > 0 AND 2 * s7 > s30",
    "p3_rolling": P3_ROLLING_SQL + """SELECT depot_id, day, first_day, cents / 100.0::DOUBLE AS units, s7 / 100.0::DOUBLE AS total_7, s30 / 100.0::DOUBLE AS total_30,
  round(s7 / 100.0::DOUBLE / 7, 6) AS avg_7, round(s30 / 100.0::DOUBLE / 30, 6) AS avg_30 FROM rolled""",
}
