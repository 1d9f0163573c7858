"""Queries over rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from opledger.operators import ratelimit as rl
from opledger.plans.book import Book
from opledger.plans.inputs import EVENTS, events

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle

#: One token in six hours, three at once: a rate of 1/21600 a second.
HOURS, BURST = 6, 3.0
RATE = 1 / (3600 * HOURS)


def bucket_requests(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("event_id").alias("idx"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tenant"), "ts_ms", F.lit(1.0).alias("n"), (F.col("k") % 2).alias("gateway"))


def _overrides(spark, sf):
    return spark.createDataFrame([("t0", 100.0, 50.0), ("t1", 4.0, 0.0)], "tenant string, rate double, burst double")


def _limits(requests):
    return requests.select("tenant").distinct().select("tenant", F.lit(RATE).alias("rate"), F.lit(BURST).alias("burst"))


@query(f"""WITH {EVENTS}, o(tenant, rate, burst) AS (VALUES ('t0', 100.0, 50.0), ('t1', 4.0, 0.0)), t AS (SELECT DISTINCT 't' || (user_id % 20) AS tenant FROM ev),
j AS (SELECT t.tenant, CAST(coalesce(o.rate, 10.0) AS DOUBLE) AS rate, CAST(coalesce(o.burst, 0.0) AS DOUBLE) AS burst FROM t LEFT JOIN o USING (tenant))
SELECT tenant, rate, CASE WHEN burst <= 0 THEN 2 * rate ELSE burst END AS burst FROM j""")
def rl_effective_limits(spark, sf):
    tenants = events(spark, sf).select(F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("tenant"))
    return rl.effective_limits(tenants, _overrides(spark, sf))


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN gap > 0 THEN least(20.0, CAST(k AS DOUBLE) % 20 + gap * 1.0 / 1000.0) ELSE CAST(k AS DOUBLE) % 20 END AS tokens
FROM (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS gap FROM ev) t""")
def rl_refill(spark, sf):
    from pyspark.sql import Window

    e = events(spark, sf).withColumn("before", F.coalesce(F.lag("ts_ms").over(Window.partitionBy("user_id").orderBy("event_id")), F.col("ts_ms")))
    return e.select("event_id", rl.refill(F.col("k").cast("double") % 20, F.col("before"), F.col("ts_ms"), F.lit(1.0), F.lit(20.0)).alias("tokens"))


_FOLD = EVENTS + f""", r AS (SELECT event_id AS idx, 'u' || user_id AS tenant, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn FROM ev),
f AS (SELECT DISTINCT tenant, CAST(0 AS BIGINT) AS rn, CAST({BURST} AS DOUBLE) AS tokens, CAST(NULL AS BIGINT) AS last_ms, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BOOLEAN) AS admitted, CAST(0 AS DOUBLE) AS had FROM r
  UNION ALL
  SELECT tenant, rn, CASE WHEN now >= 1 THEN now - 1 ELSE tokens END, CASE WHEN now >= 1 THEN greatest(ts_ms, coalesce(last_ms, ts_ms)) ELSE last_ms END, idx, now >= 1, now
  FROM (SELECT r.tenant, r.rn, r.idx, r.ts_ms, f.tokens, f.last_ms, CASE WHEN f.last_ms IS NOT NULL AND r.ts_ms > f.last_ms THEN least({BURST}, f.tokens + (r.ts_ms - f.last_ms) * {RATE!r} / 1000.0) ELSE f.tokens END AS now
        FROM f JOIN r ON r.tenant = f.tenant AND r.rn = f.rn + 1) x)"""


@query(f"WITH RECURSIVE {_FOLD} SELECT idx, tenant, admitted FROM f WHERE rn > 0")
def rl_admission(spark, sf):
    r = bucket_requests(spark, sf)
    return rl.admit(r, _limits(r)).select("idx", "tenant", "admitted")


@query(f"""WITH RECURSIVE {_FOLD}, s AS (SELECT tenant, max(ts_ms) - min(ts_ms) AS span_ms FROM r GROUP BY tenant)
SELECT f.tenant, CAST(sum(CASE WHEN admitted THEN 1 ELSE 0 END) AS DOUBLE) AS admitted, CAST(floor({BURST} + {RATE!r} * any_value(span_ms) / 1000.0) AS BIGINT) AS allowed,
  sum(CASE WHEN admitted THEN 1 ELSE 0 END) <= {BURST} + {RATE!r} * any_value(span_ms) / 1000.0 AS within
FROM f JOIN s ON s.tenant = f.tenant WHERE rn > 0 GROUP BY f.tenant""")
def rl_budget_audit(spark, sf):
    r = bucket_requests(spark, sf)
    return rl.budget_audit(rl.admit(r, _limits(r)).drop("tenant").join(r.select("idx", "tenant"), "idx"), r, _limits(r))


#: A lease of four tokens a gateway from a burst of eight, for a day.
_LEASED, _DAY = 8.0, 86_400_000
_NEXT = "CASE WHEN f.last_ms IS NOT NULL AND r.ts_ms > f.last_ms THEN least({burst}, f.tokens + (r.ts_ms - f.last_ms) * {rate!r} / 1000.0) ELSE f.tokens END"


@query(f"""WITH RECURSIVE {EVENTS}, r AS (SELECT event_id AS idx, 'u' || user_id AS tenant, ts_ms, k % 2 AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn FROM ev),
f AS (SELECT DISTINCT tenant, CAST(0 AS BIGINT) AS rn, CAST({_LEASED} AS DOUBLE) AS tokens, CAST(NULL AS BIGINT) AS last_ms, CAST(0 AS DOUBLE) AS l0, CAST(0 AS DOUBLE) AS l1, CAST(NULL AS BIGINT) AS e0, CAST(NULL AS BIGINT) AS e1,
    CAST(NULL AS BIGINT) AS idx, false AS admitted, CAST(0 AS BIGINT) AS retry_after_ms, false AS from_lease FROM r
  UNION ALL
  SELECT tenant, rn, CASE WHEN takes THEN now - least(4.0, floor(now)) ELSE tokens END, CASE WHEN takes THEN greatest(ts_ms, coalesce(last_ms, ts_ms)) ELSE last_ms END,
    CASE WHEN g = 0 THEN CASE WHEN held >= 1 THEN held - 1 WHEN takes THEN held + least(4.0, floor(now)) - 1 ELSE held END ELSE l0 END, CASE WHEN g = 1 THEN CASE WHEN held >= 1 THEN held - 1 WHEN takes THEN held + least(4.0, floor(now)) - 1 ELSE held END ELSE l1 END,
    CASE WHEN g = 0 AND takes THEN ts_ms + {_DAY} ELSE e0 END, CASE WHEN g = 1 AND takes THEN ts_ms + {_DAY} ELSE e1 END,
    idx, held >= 1 OR takes, CASE WHEN held >= 1 OR takes THEN 0 ELSE CAST(floor(1000 * (1 - now) / {RATE!r}) AS BIGINT) END, held >= 1
  FROM (SELECT *, held < 1 AND now >= 1 AS takes FROM (
    SELECT r.tenant, r.rn, r.idx, r.ts_ms, r.g, f.tokens, f.last_ms, f.l0, f.l1, f.e0, f.e1, {_NEXT.format(burst=_LEASED, rate=RATE)} AS now,
      CASE WHEN CASE WHEN r.g = 0 THEN f.e0 ELSE f.e1 END > r.ts_ms THEN CASE WHEN r.g = 0 THEN f.l0 ELSE f.l1 END ELSE 0.0 END AS held
    FROM f JOIN r ON r.tenant = f.tenant AND r.rn = f.rn + 1) x) y)
SELECT idx, tenant, admitted, retry_after_ms, from_lease FROM f WHERE rn > 0""")
def rl_leased_admission(spark, sf):
    r = bucket_requests(spark, sf)
    limits = _limits(r).withColumn("burst", F.lit(_LEASED))
    return rl.admit_leased(r, limits, fraction=0.5, ttl_ms=_DAY)


@query(f"""WITH RECURSIVE {_FOLD}, z AS (SELECT tenant, arg_max(tokens, rn) AS tokens, max(last_ms) AS last_ms FROM f GROUP BY tenant)
SELECT tenant, CASE WHEN last_ms IS NULL THEN {BURST} ELSE least({BURST}, tokens + greatest(0, 1710000000000 - last_ms) * {RATE!r} / 1000.0) END AS tokens FROM z""")
def rl_peek(spark, sf):
    r = bucket_requests(spark, sf)
    return rl.peek(r, _limits(r), 1_710_000_000_000)
