"""Report queries over served requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from opledger.operators import reports as rp
from opledger.plans.book import Book
from opledger.plans.inputs import BENCH, bench_results

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle

ELAPSED_S = 600.0
_SUMMARY = f"""count(*) FILTER (WHERE error IS NOT NULL) AS errors, count(*) FILTER (WHERE error IS NULL) AS served,
  CAST(count(*) FILTER (WHERE error IS NULL AND prefix_hit) AS DOUBLE) / count(*) FILTER (WHERE error IS NULL) AS prefix_hit_rate, avg(prefill_ms) FILTER (WHERE error IS NULL) AS prefill_mean_ms,
  count(*) FILTER (WHERE error IS NULL AND hedged) AS hedges_launched, count(*) FILTER (WHERE error IS NULL AND hedge_won) AS hedges_won, count(*) FILTER (WHERE error IS NULL AND cached) AS cached,
  count(*) FILTER (WHERE error IS NULL) / {ELAPSED_S}::DOUBLE AS throughput, CAST(sum(tokens) FILTER (WHERE error IS NULL) AS DOUBLE) / {ELAPSED_S}::DOUBLE AS tokens_per_s"""


def _pct(value: str, q: int) -> str:
    return f"list_extract(list_sort(list({value})), CAST(least(count(*) * {q} // 100, count(*) - 1) AS INT) + 1)"


@query(f"WITH {BENCH} SELECT {_SUMMARY} FROM bench")
def bench_summary(spark, sf):
    return rp.summary(bench_results(spark, sf), ELAPSED_S)


@query(f"WITH {BENCH} SELECT phase, {_SUMMARY} FROM bench GROUP BY phase")
def bench_summary_by_phase(spark, sf):
    return rp.summary(bench_results(spark, sf), ELAPSED_S, by=("phase",))


@query(f"WITH {BENCH} SELECT error, count(*) AS n FROM bench WHERE error IS NOT NULL GROUP BY error")
def bench_error_kinds(spark, sf):
    return rp.error_kinds(bench_results(spark, sf))


@query(f"WITH {BENCH} SELECT phase, {_pct('ttft_ms', 50)} AS p50, {_pct('ttft_ms', 95)} AS p95, {_pct('ttft_ms', 99)} AS p99 FROM bench WHERE error IS NULL GROUP BY phase")
def bench_percentiles(spark, sf):
    return rp.percentiles(bench_results(spark, sf).filter("error is null"), "ttft_ms", (50, 95, 99), by=("phase",))


@query(f"WITH {BENCH} SELECT {_pct('total_ms', 50)} AS p50, {_pct('total_ms', 99)} AS p99 FROM bench")
def bench_total_percentiles(spark, sf):
    return rp.percentiles(bench_results(spark, sf), "total_ms", (50, 99))


@query(f"WITH {BENCH} SELECT avg(workers) AS spread, count(*) AS prefixes FROM (SELECT item_id, count(DISTINCT worker) AS workers FROM bench WHERE error IS NULL GROUP BY item_id)")
def bench_prefix_spread(spark, sf):
    return rp.prefix_spread(bench_results(spark, sf))


def _stats(rows):
    return rows.groupBy("worker").agg(F.count("*").alias("requests"), F.count_if("cached").alias("hits"), F.max("tokens").alias("tokens"))


@query(f"""WITH {BENCH}, a AS (SELECT worker, count(*) AS requests, count(*) FILTER (WHERE cached) AS hits, max(tokens) AS tokens FROM bench GROUP BY worker),
b AS (SELECT worker, count(*) AS requests, count(*) FILTER (WHERE cached) AS hits FROM bench WHERE trial < 2 GROUP BY worker)
SELECT a.worker, a.requests - coalesce(b.requests, 0) AS requests, a.hits - coalesce(b.hits, 0) AS hits, a.tokens FROM a LEFT JOIN b ON a.worker = b.worker""")
def bench_stats_delta(spark, sf):
    b = bench_results(spark, sf)
    return rp.stats_delta(_stats(b.filter("trial < 2")), _stats(b), "worker", ["requests", "hits"], ["tokens"])


@query(f"""WITH {BENCH}, t AS (SELECT phase, trial, avg(ttft_ms) AS v FROM bench WHERE error IS NULL GROUP BY phase, trial)
SELECT phase, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS stdev, count(*) AS trials FROM t GROUP BY phase""")
def bench_trials(spark, sf):
    per = bench_results(spark, sf).filter("error is null").groupBy("phase", "trial").agg(F.avg("ttft_ms").alias("v"))
    return rp.trials(per, "v", "phase")


@query(f"WITH {BENCH} SELECT avg(CASE WHEN cached THEN 1.0 ELSE 0.0 END) AS hit_rate FROM bench WHERE tenant = 't1'")
def bench_cache_hit_rate(spark, sf):
    return bench_results(spark, sf).filter("tenant = 't1'").agg(F.avg(F.when(F.col("cached"), 1.0).otherwise(0.0)).alias("hit_rate"))


@query(f"WITH {BENCH} SELECT tenant, cached, hedged, count(*) AS n FROM bench WHERE error IS NULL GROUP BY ALL")
def metric_counters(spark, sf):
    return rp.counters(bench_results(spark, sf).filter("error is null"), "tenant", "cached", "hedged")


@query(f"WITH {BENCH} SELECT tenant, cached, count(*) AS n FROM bench GROUP BY ROLLUP (tenant, cached)")
def metric_counters_rollup(spark, sf):
    return bench_results(spark, sf).rollup("tenant", "cached").agg(F.count("*").alias("n"))


_HIST = f"""h AS ({" UNION ALL ".join(f"SELECT '{b}' AS le, {b} AS ord, count(*) FILTER (WHERE ttft_ms <= {b}) AS n FROM bench" for b in rp.TTFT_BOUNDS)} UNION ALL SELECT '+Inf', 1e18, count(*) FROM bench)"""


@query(f"WITH {BENCH}, {_HIST} SELECT le, n FROM h")
def metric_histogram(spark, sf):
    return rp.histogram(bench_results(spark, sf), "ttft_ms")


@query(f"""WITH {BENCH}, {_HIST}, w AS (SELECT *, coalesce(lag(ord) OVER (ORDER BY ord), 0) AS lower_, coalesce(lag(n) OVER (ORDER BY ord), 0) AS below, max(n) OVER () AS total FROM h),
q AS (SELECT q FROM (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(q)), r AS (SELECT q.q, w.ord, w.lower_ + (w.ord - w.lower_) * (q.q * total - below) / (n - below) AS value FROM w CROSS JOIN q WHERE n >= q.q * total AND n > below)
SELECT q, CAST(arg_min(value, ord) AS DOUBLE) AS value FROM r GROUP BY q""")
def metric_quantile(spark, sf):
    h = rp.histogram(bench_results(spark, sf), "ttft_ms")
    parts = [rp.histogram_quantile(h, q).select(F.lit(q).alias("q"), "value") for q in (0.5, 0.95, 0.99)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {BENCH} SELECT request_id, CAST(sum(CASE WHEN cached THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w AS ratio FROM bench
WINDOW w AS (PARTITION BY tenant ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def metric_hit_ratio(spark, sf):
    return rp.running_ratio(bench_results(spark, sf), F.col("cached"), by="tenant", order=["request_id"]).select("request_id", "ratio")


@query(f"""WITH {BENCH}, e AS (SELECT tenant, (ts_ms // 900000 + 1 + i) * 900000 AS end_ms FROM bench CROSS JOIN range(4) r(i))
SELECT tenant, end_ms, count(*) / 3600.0::DOUBLE AS rate FROM e GROUP BY tenant, end_ms""")
def metric_rate(spark, sf):
    return rp.rate(bench_results(spark, sf), "tenant", window_ms=3_600_000, step_ms=900_000)


@query(f"""WITH {BENCH}, p AS (SELECT phase, {_SUMMARY} FROM bench GROUP BY phase), g AS (SELECT
  max(CASE WHEN phase = 'phase1' THEN prefix_hit_rate END) > max(CASE WHEN phase = 'phase0' THEN prefix_hit_rate END) AS affinity_hits_more,
  max(CASE WHEN phase = 'phase1' THEN prefill_mean_ms END) < max(CASE WHEN phase = 'phase0' THEN prefill_mean_ms END) AS affinity_prefills_less,
  max(CASE WHEN phase = 'phase2' THEN hedges_launched END) > 0 AND 2 * max(CASE WHEN phase = 'phase2' THEN hedges_launched END) < max(CASE WHEN phase = 'phase2' THEN served END) AS hedges_some,
  max(CASE WHEN phase = 'phase2' THEN errors END) = 0 AS no_errors FROM p)
SELECT * FROM (SELECT 'affinity_hits_more' AS gate, affinity_hits_more AS passed FROM g UNION ALL SELECT 'affinity_prefills_less', affinity_prefills_less FROM g UNION ALL SELECT 'hedges_some', hedges_some FROM g UNION ALL SELECT 'no_errors', no_errors FROM g)""")
def e2e_gates(spark, sf):
    name = F.when(F.col("phase") == "phase0", "A").when(F.col("phase") == "phase1", "B").when(F.col("phase") == "phase2", "C").otherwise("D")
    return rp.gates(rp.summary(bench_results(spark, sf).withColumn("phase", name), ELAPSED_S, by=("phase",)))


@query(f"""WITH {BENCH}, o AS (SELECT {_pct('ttft_ms', 95)} AS ttft_p95, {_pct('total_ms', 95)} AS total_p95 FROM bench WHERE error IS NULL), s AS (SELECT CAST(count(*) FILTER (WHERE error IS NULL) AS DOUBLE) / count(*) AS answered FROM bench)
SELECT ttft_p95, total_p95, ttft_p95 < 3000 AS ttft_ok, total_p95 < 5000 AS total_ok, answered > 0.95 AS answered_ok FROM o CROSS JOIN s""")
def load_thresholds(spark, sf):
    return rp.thresholds(bench_results(spark, sf))
