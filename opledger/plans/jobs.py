"""Queries over job queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from opledger.operators import jobs
from opledger.plans.book import Book
from opledger.plans.inputs import EVENTS, events

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle

LEASE_MS, NOW_MS = 3_600_000, 1_706_000_000_000


def commands(spark, sf):
    t, k = F.col("event_type"), F.col("k")
    op = F.when(t.isin("signup", "purchase"), "submit").when(t == "view", F.when(k % 13 == 0, "reap").otherwise("claim")).when(t == "click", F.when(k % 11 == 0, "heartbeat").otherwise("complete")).otherwise("fail")
    return events(spark, sf).select(
        F.col("event_id").alias("idx"), F.concat(F.lit("q"), (F.col("user_id") % 16).cast("string")).alias("prefix"), op.alias("op"), F.col("ts_ms").alias("now_ms"),
        F.concat(F.lit("o"), F.floor("value").cast("string")).alias("idem_key"), F.concat(F.lit("w"), (F.col("user_id") % 64).cast("string")).alias("worker"), F.lit(LEASE_MS).cast("bigint").alias("lease_ms"))


COMMANDS = EVENTS + f""", commands AS (SELECT event_id AS idx, 'q' || (user_id % 16) AS prefix,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'submit' WHEN event_type = 'view' THEN CASE WHEN k % 13 = 0 THEN 'reap' ELSE 'claim' END WHEN event_type = 'click' THEN CASE WHEN k % 11 = 0 THEN 'heartbeat' ELSE 'complete' END ELSE 'fail' END AS op,
  ts_ms AS now_ms, 'o' || CAST(floor(value) AS BIGINT) AS idem_key, 'w' || (user_id % 64) AS worker, {LEASE_MS} AS lease_ms FROM ev)"""


def snapshot(spark, sf):
    """Job records as of one moment, one per event."""
    k = F.col("k")
    state = F.when(k % 5 == 0, "PENDING").when(k % 5 == 1, "RUNNING").when(k % 5 == 2, "DONE").when(k % 5 == 3, "FAILED").otherwise("STAGED")
    return events(spark, sf).select(
        F.concat(F.lit("q"), (F.col("user_id") % 16).cast("string")).alias("prefix"), F.col("event_id").alias("id"), F.col("event_id").alias("idx"), state.alias("state"), (k % 3).alias("gen"), (k % 4).alias("attempts"),
        F.concat(F.lit("w"), (k % 6).cast("string")).alias("worker"), (F.col("ts_ms") + k * 60_000).alias("lease_until_ms"), F.col("ts_ms").alias("submitted_ms"), F.col("user_id"), "k")


SNAP = EVENTS + """, snap AS (SELECT 'q' || (user_id % 16) AS prefix, event_id AS id, event_id AS idx,
  CASE k % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'DONE' WHEN 3 THEN 'FAILED' ELSE 'STAGED' END AS state, k % 3 AS gen, k % 4 AS attempts, 'w' || (k % 6) AS worker,
  ts_ms + k * 60000 AS lease_until_ms, ts_ms AS submitted_ms, user_id, k FROM ev)"""


@query(f"""WITH {COMMANDS}, s AS (SELECT idx, prefix, min(idx) OVER (PARTITION BY prefix, idem_key) AS first FROM commands WHERE op = 'submit'),
ids AS (SELECT prefix, first, row_number() OVER (PARTITION BY prefix ORDER BY first) AS id FROM (SELECT DISTINCT prefix, first FROM s) f)
SELECT s.idx, s.prefix, i.id, s.idx = s.first AS created FROM s JOIN ids i ON i.prefix = s.prefix AND i.first = s.first""")
def job_idempotent_ids(spark, sf):
    return jobs.idempotent_ids(commands(spark, sf).filter("op = 'submit'"))


@query(f"""WITH {COMMANDS}, o AS (SELECT prefix, sum(CASE op WHEN 'submit' THEN 1 WHEN 'complete' THEN -1 ELSE 0 END) OVER (PARTITION BY prefix ORDER BY idx) AS open FROM commands)
SELECT prefix, CAST(max(open) AS BIGINT) AS most_open, max(open) > 32 AS exceeded FROM o GROUP BY prefix""")
def job_admission_audit(spark, sf):
    return jobs.admission_audit(commands(spark, sf), 32)


@query()
def job_lifecycle(spark, sf):
    return jobs.lifecycle(commands(spark, sf), max_queue=64)


@query()
def job_final_states(spark, sf):
    return jobs.final_states(commands(spark, sf), max_queue=64)


@query(f"WITH {SNAP} SELECT id, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END AS becomes, gen + 1 AS gen FROM snap WHERE state = 'RUNNING' AND lease_until_ms < {NOW_MS}")
def job_expired_leases(spark, sf):
    return jobs.expired_leases(snapshot(spark, sf), NOW_MS)


@query(f"WITH {SNAP} SELECT id, prefix FROM snap WHERE state = 'STAGED' AND {NOW_MS} - submitted_ms > 60000")
def job_expired_stages(spark, sf):
    return jobs.expired_stages(snapshot(spark, sf), NOW_MS).select("id", "prefix")


_VERDICT = "CASE WHEN state = 'FAILED' THEN 'Terminal' WHEN state = 'DONE' THEN CASE WHEN gen = k % 2 THEN 'ok' ELSE 'Fenced' END WHEN state = 'RUNNING' AND gen = k % 2 THEN 'ok' ELSE 'Fenced' END"


@query(f"WITH {SNAP} SELECT id, {_VERDICT} AS verdict, CASE {_VERDICT} WHEN 'ok' THEN 'OK' ELSE 'FailedPrecondition' END AS code FROM snap")
def job_fence_verdicts(spark, sf):
    v = jobs.holder_verdict(F.col("state"), F.col("gen"), F.col("k") % 2)
    return snapshot(spark, sf).select("id", v.alias("verdict"), jobs.error_code(v).alias("code"))


@query(f"""WITH {SNAP}, w AS (SELECT user_id AS id, idx, state, gen, worker, attempts, lag((state, gen, worker, attempts)) OVER (PARTITION BY user_id ORDER BY idx) AS before FROM snap)
SELECT id, idx, state, gen, worker, attempts FROM w WHERE before IS NULL OR before <> (state, gen, worker, attempts)""")
def job_watch_changes(spark, sf):
    return jobs.watch(snapshot(spark, sf).drop("id").withColumnRenamed("user_id", "id")).select("id", "idx", "state", "gen", "worker", "attempts")


@query(f"""WITH {SNAP}, d AS (SELECT prefix, max(id) AS tail, coalesce(min(CASE WHEN state NOT IN ('DONE', 'FAILED') THEN id END), max(id) + 1) AS head FROM snap GROUP BY prefix)
SELECT prefix, tail, head, tail - head AS depth FROM d""")
def job_queue_depth(spark, sf):
    return jobs.depth(snapshot(spark, sf))


def _completes(spark, sf):
    s = snapshot(spark, sf)
    return s.filter("state = 'DONE' or k % 50 = 1").select("prefix", "id", "gen", (F.col("k") % 47 != 2).alias("accepted"), F.concat(F.lit("r"), (F.col("k") % 9).cast("string")).alias("result"))


@query(f"""WITH {SNAP}, c AS (SELECT prefix, id, gen, 'r' || (k % 9) AS result FROM snap WHERE (state = 'DONE' OR k % 50 = 1) AND k % 47 <> 2),
a AS (SELECT prefix, id, count(DISTINCT gen) AS n, max(result) AS won FROM c GROUP BY prefix, id), j AS (SELECT prefix, id, state, 'r' || (CASE WHEN k % 37 = 0 THEN k % 8 ELSE k % 9 END) AS kept FROM snap),
b AS (SELECT coalesce(a.prefix, j.prefix) AS prefix, coalesce(a.id, j.id) AS id, CASE WHEN n > 1 THEN 'accepted twice' WHEN state = 'DONE' AND n IS NULL THEN 'done without acceptance' WHEN n IS NOT NULL AND coalesce(state <> 'DONE', true) THEN 'accepted but not done' WHEN state = 'DONE' AND won <> kept THEN 'another result' END AS violation
  FROM a FULL JOIN j ON a.prefix = j.prefix AND a.id = j.id) SELECT * FROM b WHERE violation IS NOT NULL""")
def job_exactly_once_audit(spark, sf):
    kept = snapshot(spark, sf).withColumn("result", F.concat(F.lit("r"), F.when(F.col("k") % 37 == 0, F.col("k") % 8).otherwise(F.col("k") % 9).cast("string")))
    return jobs.exactly_once(_completes(spark, sf), kept)


@query(f"""WITH {COMMANDS}, s AS (SELECT prefix, idem_key, min(idx) OVER (PARTITION BY prefix, idem_key) + CASE WHEN idx % 97 = 0 THEN 1 ELSE 0 END AS id FROM commands WHERE op = 'submit')
SELECT prefix, idem_key, count(DISTINCT id) AS ids FROM s GROUP BY prefix, idem_key HAVING count(DISTINCT id) > 1""")
def job_idempotency_audit(spark, sf):
    from pyspark.sql import Window

    s = commands(spark, sf).filter("op = 'submit'")
    first = F.min("idx").over(Window.partitionBy("prefix", "idem_key"))
    return jobs.idempotency(s.withColumn("id", first + F.when(F.col("idx") % 97 == 0, 1).otherwise(0)))


_LEAD = COMMANDS + f""", t AS (SELECT idx, prefix, worker AS holder, now_ms, row_number() OVER (PARTITION BY prefix ORDER BY idx) AS rn FROM commands WHERE op = 'claim'),
f AS (SELECT DISTINCT prefix, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS leader, CAST(0 AS BIGINT) AS until, CAST(NULL AS VARCHAR) AS holder FROM t
  UNION ALL SELECT t.prefix, t.rn, t.idx, CASE WHEN f.leader IS NULL OR f.leader = t.holder OR NOT f.until > t.now_ms THEN t.holder ELSE f.leader END,
    CASE WHEN f.leader IS NULL OR f.leader = t.holder OR NOT f.until > t.now_ms THEN t.now_ms + {3 * LEASE_MS} ELSE f.until END, t.holder FROM f JOIN t ON t.prefix = f.prefix AND t.rn = f.rn + 1)"""


@query(f"WITH RECURSIVE {_LEAD} SELECT idx, prefix, leader, leader = holder AS leads FROM f WHERE rn > 0")
def job_leader(spark, sf):
    a = commands(spark, sf).filter("op = 'claim'").select("idx", "prefix", F.col("worker").alias("holder"), "now_ms")
    return jobs.leader(a, 3 * LEASE_MS)
