"""Queries over the operation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from opledger.operators import kv
from opledger.plans.book import Book
from opledger.plans.inputs import OPLOG, oplog

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle


def _no_cas(spark, sf):
    return kv.applied(oplog(spark, sf)).filter("op <> 'CAS'")


_NO_CAS = OPLOG + ", a AS (SELECT * FROM classed WHERE class = 'applied' AND op <> 'CAS')"
_STATE = """SELECT key, value FROM (SELECT key, arg_max(op, idx) AS op, arg_max(value, idx) AS value FROM {0} WHERE op IN ('PUT', 'DELETE') GROUP BY key) WHERE op = 'PUT'"""


@query(f"WITH {OPLOG} SELECT class, op, count(*) AS n FROM classed GROUP BY class, op")
def kv_dedup_classes(spark, sf):
    return kv.classify(oplog(spark, sf)).groupBy("class", "op").agg(F.count("*").alias("n"))


@query(f"WITH {_NO_CAS} {_STATE.format('a')}")
def kv_dedup_state(spark, sf):
    return kv.state(_no_cas(spark, sf))


_READS = """seen AS (SELECT *, last_value(CASE WHEN op IN ('PUT', 'DELETE') THEN op END IGNORE NULLS) OVER w AS last_op, last_value(CASE WHEN op IN ('PUT', 'DELETE') THEN value END IGNORE NULLS) OVER w AS last_value
  FROM a WINDOW w AS (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_EXISTED = "SELECT idx, key, coalesce(prev = 'PUT', false) AS existed FROM (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY idx) AS prev FROM a WHERE op IN ('PUT', 'DELETE')) WHERE op = 'DELETE'"


@query(f"WITH {_NO_CAS} {_EXISTED}")
def kv_existed_flags(spark, sf):
    return kv.existed(_no_cas(spark, sf))


@query(f"WITH {_NO_CAS}, {_READS} SELECT idx, key, coalesce(last_op = 'PUT', false) AS found, CASE WHEN last_op = 'PUT' THEN last_value END AS value FROM seen WHERE op = 'GET'")
def kv_get_as_of(spark, sf):
    return kv.reads(_no_cas(spark, sf))


@query(f"WITH {_NO_CAS} SELECT count(*) AS live_keys FROM ({_STATE.format('a')})")
def kv_live_count(spark, sf):
    return kv.state(_no_cas(spark, sf)).agg(F.count("*").alias("live_keys"))


@query(f"""WITH {OPLOG}, told AS (
  SELECT idx, key, client_id, request_id, op, value, CASE WHEN newest IS NULL OR request_id > newest THEN 'applied' WHEN request_id = newest THEN 'duplicate' ELSE 'stale' END AS class
  FROM (SELECT *, max(request_id) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM oplog WHERE op <> 'CAS') t
), a AS (SELECT * FROM told WHERE class = 'applied'), {_READS}, ex AS ({_EXISTED}), own AS (
  SELECT t.*, CASE WHEN t.class = 'applied' THEN CASE t.op WHEN 'PUT' THEN 'ok' WHEN 'DELETE' THEN 'existed=' || CASE WHEN ex.existed THEN 'true' ELSE 'false' END
    ELSE CASE WHEN s.last_op = 'PUT' THEN 'value=' || s.last_value ELSE 'absent' END END END AS own
  FROM told t LEFT JOIN ex ON ex.idx = t.idx LEFT JOIN seen s ON s.idx = t.idx
), filled AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS result FROM own)
SELECT idx, client_id, request_id, result FROM filled WHERE class = 'duplicate'""")
def kv_last_result(spark, sf):
    return kv.results(oplog(spark, sf).filter("op <> 'CAS'")).filter("class = 'duplicate'").select("idx", "client_id", "request_id", "result")


_FOLD = OPLOG + """, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS rn FROM classed WHERE class = 'applied'),
f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS val, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BOOLEAN) AS swapped, CAST(NULL AS VARCHAR) AS current FROM a
  UNION ALL
  SELECT a.key, a.rn, CASE WHEN a.op = 'PUT' THEN a.value WHEN a.op = 'DELETE' THEN NULL
      WHEN a.op = 'CAS' AND (CASE WHEN a.expect_absent THEN f.val IS NULL ELSE f.val IS NOT NULL AND f.val = a.expected END) THEN a.value ELSE f.val END,
    a.idx, a.op, CASE WHEN a.expect_absent THEN f.val IS NULL ELSE f.val IS NOT NULL AND f.val = a.expected END, f.val
  FROM f JOIN a ON a.key = f.key AND a.rn = f.rn + 1)"""


@query(f"WITH RECURSIVE {_FOLD} SELECT idx, key, swapped, current FROM f WHERE op = 'CAS'")
def kv_cas_outcomes(spark, sf):
    return kv.cas_outcomes(kv.applied(oplog(spark, sf)))


@query(f"WITH RECURSIVE {_FOLD} SELECT key, arg_max(val, rn) AS value FROM (SELECT key, rn, coalesce(val, '') AS val FROM f WHERE rn > 0) GROUP BY key HAVING arg_max(val, rn) <> ''")
def kv_cas_final_state(spark, sf):
    return kv.cas_state(kv.applied(oplog(spark, sf)))


_CUT = 5000


@query(f"""WITH {_NO_CAS}, full_state AS ({_STATE.format('a')}), snap AS ({_STATE.format(f'(SELECT * FROM a WHERE idx <= {_CUT})')}),
joined AS (SELECT {_CUT} AS idx, key, 'PUT' AS op, value FROM snap UNION ALL SELECT idx, key, op, value FROM a WHERE idx > {_CUT}), again AS ({_STATE.format('joined')})
SELECT (SELECT count(*) FROM full_state) AS live_keys, (SELECT count(*) FROM (SELECT * FROM full_state EXCEPT SELECT * FROM again)) + (SELECT count(*) FROM (SELECT * FROM again EXCEPT SELECT * FROM full_state)) AS differences""")
def kv_snapshot_tail_equals_full(spark, sf):
    log = _no_cas(spark, sf)
    full, again = kv.state(log), kv.snapshot_and_tail(log, _CUT)
    both = full.withColumn("side", F.lit(1)).unionByName(again.withColumn("side", F.lit(2))).groupBy("key", "value").agg(F.sum("side").alias("sides"))
    return both.agg(F.count_if(F.col("sides") != 2).alias("live_keys"), F.count_if(F.col("sides") != 3).alias("differences"))


@query(f"WITH {OPLOG} SELECT count(*) AS delivered, count(DISTINCT (client_id, request_id)) AS distinct_requests, count(DISTINCT client_id) AS identities, count(*) - count(DISTINCT (client_id, request_id)) AS duplicates FROM oplog")
def kv_redelivery_stats(spark, sf):
    return kv.redelivery_stats(oplog(spark, sf))


@query(f"WITH {OPLOG} SELECT CAST(sum((n + 511) // 512) AS BIGINT) AS batches, CAST(sum(n) AS BIGINT) AS entries FROM (SELECT ts_ms // 3600000 AS slot, count(*) AS n FROM oplog GROUP BY slot)")
def kv_batch_stats(spark, sf):
    return kv.batch_stats(oplog(spark, sf), window_ms=3_600_000)


@query(f"WITH {OPLOG} SELECT idx, CASE WHEN class = 'stale' THEN 'FailedPrecondition' END AS error FROM classed WHERE class = 'stale'")
def kv_write_errors(spark, sf):
    return kv.write_errors(oplog(spark, sf)).filter("error is not null").select("idx", "error")
