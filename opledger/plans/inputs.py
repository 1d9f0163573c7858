"""Inputs of the queries, derived from the driver's tables; each also as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` from their properties, ``n`` in their user, and ``ts_ms``, whatever the session's time zone."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = table(spark, sf_dir, "events").withColumn("ts_ms", ms).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint"))


EVENTS = """ev AS (SELECT *, epoch_us(ts) // 1000 AS ts_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation log: 40 keys, a client per user, some requests sent again or late."""
    late = F.when(F.col("k") % 5 == 0, 1).when(F.col("k") % 7 == 0, 2).otherwise(0)
    op = F.when(F.col("event_type").isin("signup", "purchase"), "PUT").when(F.col("event_type") == "click", "GET").when(F.col("event_type") == "view", "CAS").otherwise("DELETE")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("idx"), F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_id"),
        (F.col("n") - late).alias("request_id"), op.alias("op"), F.concat(F.lit("v"), (F.col("k") % 4).cast("string")).alias("value"),
        F.concat(F.lit("v"), F.expr("(k div 4) % 4").cast("string")).alias("expected"), (F.col("k") % 10 == 0).alias("expect_absent"), "ts_ms")


OPLOG = EVENTS + """, oplog AS (SELECT event_id AS idx, 'k' || (user_id % 40) AS key, 'c' || user_id AS client_id,
  n - CASE WHEN k % 5 = 0 THEN 1 WHEN k % 7 = 0 THEN 2 ELSE 0 END AS request_id,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'PUT' WHEN event_type = 'click' THEN 'GET' WHEN event_type = 'view' THEN 'CAS' ELSE 'DELETE' END AS op,
  'v' || (k % 4) AS value, 'v' || ((k // 4) % 4) AS expected, k % 10 = 0 AS expect_absent, ts_ms FROM ev),
classed AS (SELECT *, CASE WHEN newest IS NULL OR request_id > newest THEN 'applied' WHEN request_id = newest THEN 'duplicate' ELSE 'stale' END AS class
  FROM (SELECT *, max(request_id) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM oplog) t)"""


#: Workers of the placement queries: the eight first suppliers, their load from the key.
LEASE_BASE_MS = 1_704_067_200_000


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey").limit(8)
    key = F.col("s_suppkey")
    return s.select(F.concat(F.lit("w"), key.cast("string")).alias("id"), (key % 5).cast("bigint").alias("inflight"), (F.lit(LEASE_BASE_MS) + key * 86_400_000).alias("lease_until_ms"))


WORKERS = f"""workers AS (SELECT 'w' || s_suppkey AS id, CAST(s_suppkey % 5 AS BIGINT) AS inflight, {LEASE_BASE_MS} + s_suppkey * 86400000 AS lease_until_ms
  FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 8))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving requests: a tenant, a benchmark text as prompt, and the number of tokens asked for."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("prompt"))
    count = b.agg(F.count("*").alias("items"))
    e = events(spark, sf_dir).crossJoin(F.broadcast(count))  # the second side is one row
    e = e.withColumn("item_id", F.col("event_id") % F.col("items"))
    return e.join(b, "item_id").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("tenant"), "ts_ms", "item_id", "prompt",
        (8 * (1 + F.col("k") % 4)).alias("max_tokens"), (F.col("k") % 9 == 0).alias("no_cache"), "k", "value")


REQUESTS = EVENTS + """, requests AS (SELECT event_id AS request_id, 't' || (user_id % 20) AS tenant, ts_ms, b.item_id, b.text AS prompt,
  8 * (1 + k % 4) AS max_tokens, k % 9 = 0 AS no_cache, k, value
  FROM ev JOIN benchmark b ON b.item_id = ev.event_id % (SELECT count(*) FROM benchmark))"""


def bench_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact table of served requests, all integers: latencies, worker, hedging, prefix and cache hits."""
    r = requests(spark, sf_dir)
    k, i = F.col("k"), F.col("request_id")
    ttft = 20 + (k * 37 + i * 11) % 700
    return r.select(
        "request_id", "tenant", "ts_ms", "item_id", F.concat(F.lit("w"), (i % 4).cast("string")).alias("worker"), F.concat(F.lit("phase"), F.expr("cast(request_id div 7 as bigint)") % 4).alias("phase"), (F.expr("request_id div 28") % 5).alias("trial"),
        ttft.alias("ttft_ms"), (ttft + F.col("max_tokens") * 12).alias("total_ms"), F.col("max_tokens").alias("tokens"), (ttft > 600).alias("hedged"), ((ttft > 600) & (k % 2 == 0)).alias("hedge_won"),
        (k % 3 == 0).alias("prefix_hit"), (20 + k).alias("prefill_ms"), (k % 11 == 0).alias("cached"), F.when(k % 13 == 0, F.lit("deadline exceeded")).alias("error"))


BENCH = REQUESTS + """, bench AS (SELECT request_id, tenant, ts_ms, item_id, 'w' || (request_id % 4) AS worker, 'phase' || ((request_id // 7) % 4) AS phase, (request_id // 28) % 5 AS trial,
  ttft AS ttft_ms, ttft + max_tokens * 12 AS total_ms, max_tokens AS tokens, ttft > 600 AS hedged, ttft > 600 AND k % 2 = 0 AS hedge_won,
  k % 3 = 0 AS prefix_hit, 20 + k AS prefill_ms, k % 11 = 0 AS cached, CASE WHEN k % 13 = 0 THEN 'deadline exceeded' END AS error
  FROM (SELECT *, 20 + (k * 37 + request_id * 11) % 700 AS ttft FROM requests) t)"""
