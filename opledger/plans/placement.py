"""Queries over workers and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from opledger.functions.hashing import FNV64_OFFSET, FNV64_PRIME, GOLDEN, MIX_A, MIX_B, fnv64_hex
from opledger.operators import placement as pl
from opledger.plans.book import Book
from opledger.plans.inputs import EVENTS, LEASE_BASE_MS, REQUESTS, WORKERS, events, requests, table, workers

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle

DAY = 86_400_000
RUNES, FACTOR = 64, 1.25


def fnv64_sql(text: str) -> str:
    """FNV-1a, 64 bits, of a text expression as UHUGEINT."""
    bytes_ = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST(('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2)) AS UHUGEINT))"
    return f"list_reduce({bytes_}, lambda h, b: (xor(h, b) * {FNV64_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT, {FNV64_OFFSET}::UHUGEINT)"


_SCORES = SCORES = f"""pre AS (SELECT DISTINCT substr(text, 1, {RUNES}) AS prefix FROM benchmark), ph AS (SELECT prefix, {fnv64_sql('prefix')} AS h FROM pre),
wh AS (SELECT *, ({fnv64_sql('id')} * {GOLDEN}::UHUGEINT) % 18446744073709551616::UHUGEINT AS g FROM workers),
s0 AS (SELECT prefix, id, inflight, xor(h, g) AS x FROM ph CROSS JOIN wh),
s1 AS (SELECT prefix, id, inflight, (xor(x, x >> 33) * {MIX_A}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM s0),
s2 AS (SELECT prefix, id, inflight, (xor(x, x >> 33) * {MIX_B}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM s1),
scored AS (SELECT prefix, id, inflight, xor(x, x >> 33) AS score FROM s2),
ranks AS (SELECT prefix, id, inflight, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, id) AS rank FROM scored)"""


def _prompts(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("text").alias("prompt"))


def _ranks(spark, sf):
    return pl.ranked(_prompts(spark, sf), workers(spark, sf), runes=RUNES)


@query(f"WITH {WORKERS} SELECT id, inflight, lease_until_ms FROM workers WHERE lease_until_ms > {LEASE_BASE_MS + 3 * DAY}")
def route_live_set(spark, sf):
    return pl.live(workers(spark, sf), F.lit(LEASE_BASE_MS + 3 * DAY))


@query(f"WITH {WORKERS}, {REQUESTS} SELECT r.request_id, count(w.id) AS live_workers FROM requests r LEFT JOIN workers w ON w.lease_until_ms > r.ts_ms GROUP BY r.request_id")
def route_live_at_request(spark, sf):
    r, w = requests(spark, sf), workers(spark, sf)
    return r.join(F.broadcast(w), w.lease_until_ms > r.ts_ms, "left").groupBy("request_id").agg(F.count("id").alias("live_workers"))  # eight workers


@query(f"WITH {WORKERS} SELECT arg_min(id, inflight * 1000 + CAST(substr(id, 2) AS BIGINT)) AS worker FROM workers")
def route_least_loaded(spark, sf):
    return pl.least_loaded(workers(spark, sf))


@query(f"WITH {WORKERS}, {_SCORES} SELECT prefix, id, rank FROM ranks")
def route_rendezvous_rank(spark, sf):
    return _ranks(spark, sf).select("prefix", "id", "rank")


@query(f"WITH {WORKERS}, {_SCORES} SELECT prefix, arg_min(id, CASE WHEN inflight < 2 THEN rank ELSE rank + 1000 END) AS worker FROM ranks GROUP BY prefix")
def route_pick(spark, sf):
    return pl.pick(_ranks(spark, sf), 2)


@query(f"""WITH {WORKERS}, {_SCORES}, b AS (SELECT ceil({FACTOR} * (sum(inflight) + 1) / count(*)) AS bound FROM workers)
SELECT prefix, arg_min(id, CASE WHEN inflight < bound THEN rank ELSE rank + 1000 END) AS worker FROM ranks CROSS JOIN b GROUP BY prefix""")
def route_pick_bounded(spark, sf):
    return pl.pick_bounded(_ranks(spark, sf), workers(spark, sf), FACTOR)


@query(f"""WITH {WORKERS}, {_SCORES}, b AS (SELECT prefix, arg_min(id, rank) AS worker FROM ranks GROUP BY prefix), a AS (SELECT prefix, arg_min(id, rank) AS worker FROM ranks WHERE id <> 'w3' GROUP BY prefix)
SELECT count(*) AS prefixes, count(*) FILTER (WHERE b.worker <> a.worker) AS moved, count(*) FILTER (WHERE b.worker <> a.worker AND b.worker <> 'w3') AS moved_elsewhere FROM b JOIN a USING (prefix)""")
def route_disruption(spark, sf):
    r = _ranks(spark, sf)
    return pl.disruption(pl.pick(r, 0), pl.pick(r, 0, exclude=("w3",)), "w3")


@query(f"WITH {WORKERS}, {_SCORES} SELECT id AS worker, count(*) AS prefixes FROM ranks WHERE rank = 1 GROUP BY id")
def route_balance(spark, sf):
    return pl.pick(_ranks(spark, sf), 0).groupBy("worker").agg(F.count("*").alias("prefixes"))


@query(f"SELECT item_id, lower(lpad(to_hex(CAST({fnv64_sql('text')} AS UBIGINT)), 16, '0')) AS fnv64 FROM benchmark")
def hash_fnv64(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fnv64_hex(F.col("text")).alias("fnv64"))


#: A lane's loads are a list in the order of the workers' ids; each request takes the first ranked worker below the bound and loads it.
@query(f"""WITH RECURSIVE {WORKERS}, {REQUESTS}, {_SCORES}, ids AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM workers),
orders AS MATERIALIZED (SELECT r.prefix, list(i.place ORDER BY r.rank) AS best FROM ranks r JOIN ids i ON i.id = r.id GROUP BY r.prefix),
q AS MATERIALIZED (SELECT request_id % 16 AS lane, request_id, best, row_number() OVER (PARTITION BY request_id % 16 ORDER BY request_id) AS rn FROM requests JOIN orders ON orders.prefix = substr(prompt, 1, {RUNES})),
f AS (SELECT DISTINCT lane, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS place, (SELECT list(inflight ORDER BY id) FROM workers) AS load FROM q
  UNION ALL SELECT lane, rn, request_id, place, list_transform(range(1, len(load) + 1), lambda i: load[i] + CASE WHEN i = place THEN 1 ELSE 0 END)
  FROM (SELECT q.lane, q.rn, q.request_id, f.load, coalesce(list_filter(q.best, lambda w: f.load[w] < ceil({FACTOR} * (list_sum(f.load) + 1) / len(f.load)))[1], q.best[1]) AS place FROM f JOIN q ON q.lane = f.lane AND q.rn = f.rn + 1) x)
SELECT f.lane, f.request_id, ids.id AS worker FROM f JOIN ids ON ids.place = f.place WHERE rn > 0""")
def route_sequential_bounded(spark, sf):
    r = requests(spark, sf).select((F.col("request_id") % 16).alias("lane"), "request_id", pl.prefix(F.col("prompt"), RUNES).alias("prefix"))
    return pl.place_in_order(r, _ranks(spark, sf), FACTOR)


@query(f"""WITH {WORKERS}, {REQUESTS}, rep AS (SELECT w.id, w.inflight, w.lease_until_ms, r.ts_ms, r.request_id, r.k % 6 AS local FROM requests r JOIN workers w ON w.id = 'w' || (r.request_id % 8))
SELECT request_id, id, greatest(0, inflight - first_value(local) OVER (PARTITION BY id, lease_until_ms ORDER BY ts_ms, request_id)) + local AS estimate FROM rep""")
def route_local_load(spark, sf):
    r, w = requests(spark, sf), workers(spark, sf)
    rep = r.join(F.broadcast(w), F.concat(F.lit("w"), (F.col("request_id") % 8).cast("string")) == w.id).withColumn("local", F.col("k") % 6)  # eight workers
    return pl.local_load(rep).select("request_id", "id", "estimate")


@query(f"""WITH {EVENTS}, g AS (SELECT 'w' || (user_id % 50) AS id, event_id AS idx, k % 5 AS inflight, CASE WHEN k % 6 = 0 THEN NULL ELSE ts_ms + 1000 * k END AS lease_until_ms FROM ev)
SELECT id, inflight, lease_until_ms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx DESC) AS rn FROM g) t WHERE rn = 1 AND lease_until_ms IS NOT NULL""")
def route_registry(spark, sf):
    k = F.col("k")
    g = events(spark, sf).select(F.concat(F.lit("w"), (F.col("user_id") % 50).cast("string")).alias("id"), F.col("event_id").alias("idx"), (k % 5).alias("inflight"), F.when(k % 6 != 0, F.col("ts_ms") + 1000 * k).alias("lease_until_ms"))
    return pl.registry(g)
