"""Queries of the serving pipeline and its cost model."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from opledger.operators import placement as pl
from opledger.operators import ratelimit as rl
from opledger.operators import serving as sv
from opledger.operators import textsim as ts
from opledger.plans.book import Book
from opledger.plans.inputs import EVENTS, REQUESTS, WORKERS, bench_results, events, requests, table, workers
from opledger.plans.placement import RUNES, SCORES
from opledger.plans.textsim import WHITE

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle


def _raw(spark, sf):
    """Requests with some tenants, prompts and token counts spoilt."""
    k = F.col("k")
    r = requests(spark, sf)
    tenant = F.when(k % 23 == 0, "").when(k % 29 == 0, F.concat(F.col("tenant"), F.lit(" x"))).when(k % 31 == 0, F.repeat(F.lit("a"), 65)).otherwise(F.col("tenant"))
    return r.withColumn("tenant", tenant).withColumn("prompt", F.when(k % 37 == 0, "").otherwise(F.col("prompt"))).withColumn("max_tokens", F.when(k % 19 == 0, 0).otherwise(F.col("max_tokens")))


_RAW = REQUESTS + """, raw AS (SELECT request_id, CASE WHEN k % 23 = 0 THEN '' WHEN k % 29 = 0 THEN tenant || ' x' WHEN k % 31 = 0 THEN repeat('a', 65) ELSE tenant END AS tenant,
  CASE WHEN k % 37 = 0 THEN '' ELSE prompt END AS prompt, CASE WHEN k % 19 = 0 THEN 0 ELSE max_tokens END AS max_tokens FROM requests)"""


@query(f"""WITH {_RAW}, d AS (SELECT request_id, CASE WHEN tenant = '' THEN 'default' ELSE tenant END AS tenant, CASE WHEN max_tokens <= 0 THEN 64 ELSE max_tokens END AS max_tokens, prompt FROM raw)
SELECT request_id, tenant, max_tokens, CASE WHEN NOT regexp_full_match(tenant, '[A-Za-z0-9._:-]{{1,64}}') THEN 'invalid tenant' WHEN prompt = '' THEN 'empty prompt' END AS error FROM d""")
def gw_validation(spark, sf):
    return sv.validated(_raw(spark, sf)).select("request_id", "tenant", "max_tokens", "error")


@query(f"""WITH {REQUESTS}, n AS (SELECT tenant FROM requests GROUP BY tenant ORDER BY min(request_id) LIMIT 12)
SELECT CASE WHEN n.tenant IS NULL THEN 'other' ELSE n.tenant END AS label, count(*) AS n FROM requests r LEFT JOIN n ON n.tenant = r.tenant GROUP BY 1""")
def gw_tenant_labels(spark, sf):
    return sv.tenant_labels(requests(spark, sf), 12).groupBy("label").agg(F.count("*").alias("n"))


def _calls(spark, sf):
    error = F.when(F.col("event_type").isin("error", "view", "click"), F.when(F.col("k") % 11 == 0, "contended").when(F.col("k") % 13 == 0, "canceled").otherwise("timeout"))
    e = events(spark, sf)
    return e.select(F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("gateway"), F.col("event_id").alias("idx"), F.col("ts_ms"), sv.outcome(error).alias("outcome"))


_COOL = 7_200_000
_CALLS = EVENTS + """, calls AS (SELECT 'g' || (user_id % 8) AS gateway, event_id AS idx, ts_ms, CASE WHEN event_type NOT IN ('error', 'view', 'click') OR k % 11 = 0 THEN 'success' WHEN k % 13 = 0 THEN 'neither' ELSE 'failure' END AS outcome,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS rn FROM ev)"""


@query(f"""WITH RECURSIVE {_CALLS}, f AS (
  SELECT DISTINCT gateway, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS idx, CAST(0 AS BIGINT) AS failures, CAST(NULL AS BIGINT) AS open_until, false AS probing, CAST(0 AS BIGINT) AS probe_at, CAST(0 AS BIGINT) AS trips, CAST(NULL AS BOOLEAN) AS allowed FROM calls
  UNION ALL
  SELECT gateway, rn, idx,
    CASE WHEN NOT allowed OR outcome = 'neither' THEN failures WHEN outcome = 'success' THEN 0 ELSE failures + 1 END,
    CASE WHEN NOT allowed OR outcome = 'neither' THEN open_until WHEN outcome = 'success' THEN NULL WHEN probes OR (open_until IS NULL AND failures + 1 >= 5) THEN ts_ms + {_COOL} ELSE open_until END,
    CASE WHEN NOT allowed THEN probing WHEN outcome = 'neither' THEN probes WHEN outcome = 'success' THEN false WHEN probes OR (open_until IS NULL AND failures + 1 >= 5) THEN false ELSE probes END,
    CASE WHEN allowed AND open_until IS NOT NULL THEN ts_ms ELSE probe_at END,
    trips + CASE WHEN allowed AND outcome = 'failure' AND (probes OR (open_until IS NULL AND failures + 1 >= 5)) THEN 1 ELSE 0 END, allowed
  FROM (SELECT *, CASE WHEN open_until IS NOT NULL AND allowed THEN true ELSE probing END AS probes FROM (
    SELECT c.gateway, c.rn, c.idx, c.ts_ms, c.outcome, f.failures, f.open_until, f.probing, f.probe_at, f.trips,
      NOT (f.open_until IS NOT NULL AND (c.ts_ms < f.open_until OR (f.probing AND c.ts_ms - f.probe_at < {_COOL}))) AS allowed
    FROM f JOIN calls c ON c.gateway = f.gateway AND c.rn = f.rn + 1) a) b)
SELECT gateway, idx, allowed, open_until IS NOT NULL AS open, trips FROM f WHERE rn > 0""")
def gw_breaker_states(spark, sf):
    return sv.breaker(_calls(spark, sf), cooldown_ms=_COOL)


_HEDGE = "h AS (SELECT request_id, CASE WHEN k % 17 = 0 THEN NULL ELSE 20 + k * 7 END AS p, CASE WHEN k % 19 = 0 THEN NULL ELSE 30 + (k * 13) % 200 END AS s FROM requests)"


@query(f"""WITH {REQUESTS}, {_HEDGE} SELECT request_id, p IS NULL OR p > 250 AS hedged, coalesce((p IS NULL OR p > 250) AND s IS NOT NULL AND (p IS NULL OR 250 + s < p), false) AS hedge_won,
  CASE WHEN p IS NULL THEN 250 + s WHEN p > 250 AND s IS NOT NULL THEN least(p, 250 + s) ELSE p END AS ttft_ms FROM h""")
def gw_hedge_outcomes(spark, sf):
    k = F.col("k")
    a = requests(spark, sf).select("request_id", F.when(k % 17 != 0, 20 + k * 7).alias("primary_ms"), F.when(k % 19 != 0, 30 + (k * 13) % 200).alias("second_ms"))
    return sv.hedged(a, 250).select("request_id", "hedged", "hedge_won", "ttft_ms")


@query(f"""WITH {EVENTS} SELECT event_id AS request_id, CASE WHEN (k + 3) % 4 <> 0 THEN 'w' || ((event_id + 1) % 8) WHEN (k + 6) % 4 <> 0 THEN 'w' || ((event_id + 2) % 8) END AS worker, (k + 3) % 4 = 0 AS retried
FROM ev""")
def gw_failover(spark, sf):
    a = requests(spark, sf).select("request_id", "k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    a = a.select("request_id", "rank", F.concat(F.lit("w"), ((F.col("request_id") + F.col("rank")) % 8).cast("string")).alias("worker"), F.when((F.col("k") + F.col("rank") * 3) % 4 == 0, "unavailable").alias("error"))
    return sv.failover(a).select("request_id", "worker", "retried")


def _tokens(spark, sf):
    r = requests(spark, sf).select("request_id", "max_tokens", "k")
    t = sv.generated(r).join(r.select("request_id", "k"), "request_id")
    return t.filter(~((F.col("k") % 6 == 0) & (F.col("index") == 3))).withColumn("done", F.col("done") & (F.col("k") % 7 != 0)).select("request_id", "index", F.concat(F.lit("t"), F.col("index").cast("string")).alias("text"), "done")


_TOKENS = "tok AS (SELECT request_id, i AS index, 't' || i AS text, i = max_tokens - 1 AND k % 7 <> 0 AS done FROM requests, unnest(range(0, max_tokens)) u(i) WHERE NOT (k % 6 = 0 AND i = 3))"


@query(f"WITH {REQUESTS}, {_TOKENS} SELECT request_id, string_agg(text, '' ORDER BY index) AS text FROM tok GROUP BY request_id HAVING bool_or(done)")
def gw_complete_streams(spark, sf):
    return sv.complete_texts(_tokens(spark, sf))


@query(f"WITH {REQUESTS}, {_TOKENS} SELECT request_id, count(*) AS tokens, max(index) + 1 AS expected, arg_max(done, index) AS ended FROM tok GROUP BY request_id HAVING count(*) <> max(index) + 1 OR NOT arg_max(done, index)")
def gw_stream_gaps(spark, sf):
    return sv.stream_gaps(_tokens(spark, sf)).select("request_id", "tokens", F.col("expected").cast("bigint").alias("expected"), "ended")


@query("SELECT item_id AS request_id, i AS index, CASE WHEN i = 0 THEN text ELSE '' END AS text, i = 1 AS done, CASE WHEN i = 1 THEN 'stop' ELSE '' END AS finish FROM benchmark CROSS JOIN (VALUES (0), (1)) v(i)")
def gw_cached_replay(spark, sf):
    return sv.cached_replay(table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), "text"))


def _pipeline(spark, sf):
    r = requests(spark, sf).withColumn("prefix", pl.prefix(F.col("prompt"), RUNES))
    asked = r.select(F.col("request_id").alias("idx"), "tenant", "ts_ms", F.lit(1.0).alias("n"))
    # the SQL's literal is a decimal, not the double next to it
    limits = r.select("tenant").distinct().select("tenant", F.lit(Decimal(repr(1 / 3600))).alias("rate"), F.lit(4.0).alias("burst"))
    admitted = rl.admit(asked, limits).select(F.col("idx").alias("request_id"), "admitted")
    hits = ts.replay(r.join(admitted.filter("admitted"), "request_id", "left_semi").select("request_id", "ts_ms", ts.gateway_key(F.col("tenant"), F.col("max_tokens"), F.col("prompt")).alias("key")), ttl_ms=0)
    placed = pl.pick_bounded(pl.ranked(r, workers(spark, sf), runes=RUNES), workers(spark, sf), 1.25)
    return sv.outcomes(r, admitted, hits, placed)


#: Admission of one request an hour a tenant, four at once; then exact hits; then the bounded placement of the prefix.
_PIPELINE = f"""{WORKERS}, {REQUESTS}, {SCORES}, bnd AS (SELECT ceil(1.25 * (sum(inflight) + 1) / count(*)) AS bound FROM workers),
placed AS (SELECT prefix, arg_min(id, CASE WHEN inflight < bound THEN rank ELSE rank + 1000 END) AS worker FROM ranks CROSS JOIN bnd GROUP BY prefix),
r AS MATERIALIZED (SELECT request_id, tenant, ts_ms, row_number() OVER (PARTITION BY tenant ORDER BY ts_ms, request_id) AS rn FROM requests),
f AS (SELECT tenant, CAST(1 AS BIGINT) AS rn, request_id, CAST(3 AS DOUBLE) AS tokens, ts_ms AS last_ms, true AS admitted FROM r WHERE rn = 1
  UNION ALL SELECT tenant, rn, request_id, CASE WHEN now >= 1 THEN now - 1 ELSE tokens END, CASE WHEN now >= 1 THEN greatest(ts_ms, last_ms) ELSE last_ms END, now >= 1
  FROM (SELECT r.*, f.tokens, f.last_ms, CASE WHEN r.ts_ms > f.last_ms THEN least(4.0, f.tokens + (r.ts_ms - f.last_ms) * {1 / 3600!r} / 1000.0) ELSE f.tokens END AS now FROM f JOIN r ON r.tenant = f.tenant AND r.rn = f.rn + 1) x),
hits AS (SELECT q.request_id, row_number() OVER (PARTITION BY q.tenant, q.max_tokens, lower(trim(regexp_replace(q.prompt, '{WHITE}', ' ', 'g'))) ORDER BY q.ts_ms, q.request_id) > 1 AS hit FROM requests q JOIN f ON f.request_id = q.request_id WHERE f.admitted),
ends AS (SELECT q.request_id, q.tenant, p.worker, CASE WHEN q.prompt = '' THEN 'invalid' WHEN NOT f.admitted THEN 'rate_limited' WHEN coalesce(h.hit, false) AND NOT q.no_cache THEN 'cached' WHEN p.worker IS NULL THEN 'no_worker' ELSE 'routed' END AS outcome
  FROM requests q JOIN f ON f.request_id = q.request_id LEFT JOIN hits h ON h.request_id = q.request_id LEFT JOIN placed p ON p.prefix = substr(q.prompt, 1, {RUNES}))"""


@query(f"WITH RECURSIVE {_PIPELINE} SELECT request_id, tenant, outcome, CASE WHEN outcome = 'routed' THEN worker END AS worker FROM ends")
def gw_pipeline_outcomes(spark, sf):
    return _pipeline(spark, sf).select("request_id", "tenant", "outcome", F.when(F.col("outcome") == "routed", F.col("worker")).alias("worker"))


@query(f"WITH RECURSIVE {_PIPELINE} SELECT outcome, count(*) AS n FROM ends GROUP BY outcome")
def gw_pipeline_counters(spark, sf):
    return _pipeline(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


def _turns(spark, sf):
    """Conversations as prompts that grow by turns."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    prompt = F.array_join(F.collect_list("text").over(w), "\n")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.concat(F.lit("w"), (F.col("conv_id") % 4).cast("string")).alias("worker"), prompt.alias("prompt"))


_TURNS = "turns AS (SELECT conv_id * 1000 + turn AS request_id, 'w' || (conv_id % 4) AS worker, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt FROM conversations)"
_BLOCKS = "b AS (SELECT request_id, worker, i AS pos, sha256(substr(prompt, 1, CAST((i + 1) * 64 AS INT))) AS hash FROM turns, unnest(range(0, length(prompt) // 64)) u(i))"
_CACHED = _BLOCKS + """, s AS (SELECT *, row_number() OVER (PARTITION BY worker, hash ORDER BY request_id) > 1 AS seen FROM b),
lead_ AS (SELECT request_id, coalesce(min(CASE WHEN NOT seen THEN pos END), count(*)) AS cached_blocks FROM s GROUP BY request_id)"""


@query(f"WITH {_TURNS}, {_BLOCKS} SELECT request_id, pos, hash FROM b")
def prefix_blocks(spark, sf):
    return _turns(spark, sf).select("request_id", F.posexplode(sv.blocks(F.col("prompt"))).alias("pos", "hash")).select("request_id", F.col("pos").cast("bigint").alias("pos"), "hash")


@query(f"WITH {_TURNS}, {_CACHED} SELECT t.request_id, coalesce(cached_blocks, 0) * 64 AS cached_chars FROM turns t LEFT JOIN lead_ l ON l.request_id = t.request_id")
def prefix_cached_chars(spark, sf):
    return sv.cached_blocks(_turns(spark, sf)).select("request_id", (F.col("cached_blocks") * 64).alias("cached_chars"))


@query(f"WITH {_TURNS}, {_CACHED} SELECT t.request_id, 20.0::DOUBLE + 0.25::DOUBLE * (length(prompt) - coalesce(cached_blocks, 0) * 64) AS prefill_ms FROM turns t LEFT JOIN lead_ l ON l.request_id = t.request_id")
def prefill_cost(spark, sf):
    return sv.cached_blocks(_turns(spark, sf)).select("request_id", sv.prefill_ms(F.length("prompt"), F.col("cached_blocks")).alias("prefill_ms"))


#: The cache as a list, oldest first: what leads and is held counts; what is used or new goes to the end, and the front goes beyond capacity.
@query(f"""WITH RECURSIVE {_TURNS}, b AS MATERIALIZED (SELECT request_id, worker, length(prompt) // 64 AS blocks,
    list_transform(range(0, length(prompt) // 64), lambda i: sha256(substr(prompt, 1, CAST((i + 1) * 64 AS INT)))) AS hashes, row_number() OVER (PARTITION BY worker ORDER BY request_id) AS rn FROM turns),
f AS (SELECT DISTINCT worker, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS cached_blocks, CAST(0 AS BIGINT) AS blocks, CAST([] AS VARCHAR[]) AS cache FROM b
  UNION ALL SELECT b.worker, b.rn, b.request_id, coalesce(list_min(list_filter(range(0, b.blocks), lambda i: NOT list_contains(f.cache, b.hashes[i + 1]))), b.blocks), b.blocks,
    list_reverse(list_reverse(list_concat(list_filter(f.cache, lambda h: NOT list_contains(b.hashes, h)), b.hashes))[1:128])
  FROM f JOIN b ON b.worker = f.worker AND b.rn = f.rn + 1)
SELECT request_id, worker, cached_blocks, blocks FROM f WHERE rn > 0""")
def prefix_lru_replay(spark, sf):
    return sv.lru_replay(_turns(spark, sf), capacity=128)


@query(f"""WITH {_TURNS}, k AS (SELECT DISTINCT sha256(substr(prompt, 1, CAST((i + 1) * 32 AS INT))) AS hash FROM turns, unnest(range(0, length(prompt) // 32)) u(i) WHERE request_id % 1000 = 0),
n AS (SELECT request_id, i, sha256(substr(prompt, 1, CAST((i + 1) * 32 AS INT))) AS hash FROM turns, unnest(range(0, length(prompt) // 32)) u(i)),
h AS (SELECT request_id, (max(i) + 1) * 32 AS reused FROM n WHERE hash IN (SELECT hash FROM k) GROUP BY request_id)
SELECT t.request_id, coalesce(reused, 0) AS reused FROM turns t LEFT JOIN h ON h.request_id = t.request_id""")
def prefix_longest_boundary(spark, sf):
    t = _turns(spark, sf)
    known = t.filter("request_id % 1000 = 0").select(F.explode(sv.blocks(F.col("prompt"), 32)).alias("hash")).distinct()
    return sv.longest_boundary(t, known)


@query(f"""WITH {WORKERS}, {REQUESTS}, b AS (SELECT 'w' || (request_id % 4) AS worker, k % 3 = 0 AS hit, k % 13 = 0 AS bad FROM requests)
SELECT worker, count(*) AS claimed, count(*) FILTER (WHERE NOT bad) AS completed, count(*) FILTER (WHERE bad) AS cancelled, count(*) FILTER (WHERE hit) AS prefix_hits, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS hit_rate FROM b GROUP BY worker""")
def worker_counters(spark, sf):
    return sv.worker_counters(bench_results(spark, sf))


@query(f"""WITH {EVENTS}, c AS (SELECT event_id AS request_id, k % 2 = 0 AS admitted, CASE k % 7 WHEN 1 THEN 'contended' WHEN 2 THEN 'canceled' WHEN 3 THEN 'timeout' END AS error FROM ev)
SELECT request_id, CASE WHEN error IS NULL THEN admitted WHEN error IN ('contended', 'canceled') THEN false ELSE true END AS admitted FROM c""")
def gw_fail_open(spark, sf):
    k = F.col("k") % 7
    error = F.when(k == 1, "contended").when(k == 2, "canceled").when(k == 3, "timeout")
    return events(spark, sf).select(F.col("event_id").alias("request_id"), sv.fail_open(error, F.col("k") % 2 == 0).alias("admitted"))
