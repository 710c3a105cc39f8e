"""Request metrics: counters, histograms, averages, gauges and their text form, over the log of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.registry import query, table

CODES = {"view": 200, "click": 302, "purchase": 201, "signup": 404, "error": 500}
CODE_SQL = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 302 WHEN 'purchase' THEN 201 WHEN 'signup' THEN 404 WHEN 'error' THEN 500 END"


def status(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for kind, code in CODES.items():
        out = F.when(c == kind, code).otherwise(out)
    return out


def status_class(code: Column) -> Column:
    k = F.floor(code / 100)
    return F.when(k.between(2, 5), F.concat(k.cast("string"), F.lit("xx"))).otherwise("other")


def epoch(ts: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


@query(f"SELECT CASE WHEN {CODE_SQL} // 100 BETWEEN 2 AND 5 THEN ({CODE_SQL} // 100) || 'xx' ELSE 'other' END AS class, count(*) AS requests FROM events GROUP BY 1")
def q37_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(status_class(status(F.col("event_type"))).alias("class")).agg(F.count("*").alias("requests"))


@query("SELECT event_type, round(coalesce(avg(value), 0.0), 4) AS avg_latency, count(*) AS requests FROM events GROUP BY event_type")
def q38_avg_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("avg_latency"), F.count("*").alias("requests"))


@query("SELECT event_id, user_id, (sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS active FROM events")
def q39_active_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.sum(step).over(w).alias("active"))


def exposition(counters: DataFrame) -> DataFrame:
    """line: the text form of rows (metric, label, value)."""
    label = F.when(F.col("label").isNotNull(), F.concat(F.lit('{class="'), "label", F.lit('"}'))).otherwise("")
    return counters.select(F.concat("metric", label, F.lit(" "), F.col("value").cast("string")).alias("line"))


@query(f"""WITH c AS (SELECT CASE WHEN {CODE_SQL} // 100 BETWEEN 2 AND 5 THEN ({CODE_SQL} // 100) || 'xx' ELSE 'other' END AS class FROM events)
SELECT 'requests_total' || ' ' || count(*) AS line FROM c UNION ALL SELECT 'responses_total{{class="' || class || '"}} ' || count(*) FROM c GROUP BY class
UNION ALL SELECT 'errors_total ' || count(*) FROM c WHERE class IN ('4xx', '5xx')""")
def q40_metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = q37_status_histogram(spark, sf_dir)
    none = F.lit(None).cast("string")
    total = classes.agg(F.sum("requests").alias("value")).select(F.lit("requests_total").alias("metric"), none.alias("label"), "value")
    by_class = classes.select(F.lit("responses_total").alias("metric"), F.col("class").alias("label"), F.col("requests").alias("value"))
    errors = classes.agg(F.coalesce(F.sum(F.when(F.col("class").isin("4xx", "5xx"), F.col("requests"))), F.lit(0)).alias("value")).select(F.lit("errors_total"), none, "value")
    return exposition(total.union(by_class).union(errors))


@query("SELECT user_id, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS hour, count(*) AS requests, count(*) > 3 AS limited FROM events GROUP BY ALL")
def q49_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user in an hour, and whether they exceed the rate."""
    hour = F.floor(epoch("ts") / 3600) * 3600
    return table(spark, sf_dir, "events").groupBy("user_id", hour.alias("hour")).agg(F.count("*").alias("requests"), (F.count("*") > 3).alias("limited"))


@query("SELECT event_type, count(*) AS requests, sum(CASE WHEN value >= 0 THEN round(value * 100)::BIGINT ELSE 0 END)::BIGINT AS upload_bytes FROM events GROUP BY event_type")
def q52_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("value") >= 0, F.round(F.col("value") * 100).cast("bigint")).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.sum(size).alias("upload_bytes"))
