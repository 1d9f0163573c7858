"""Audit and replicated-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opledger.operators import audit, consensus
from opledger.plans.book import Book
from opledger.plans.inputs import EVENTS, REQUESTS, events, requests

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle


def _history(spark, sf):
    """A sequential register history with overlapping intervals: puts and reads of 64-operation stretches a key."""
    e, k = events(spark, sf), F.col("k")
    from pyspark.sql import Window

    stretch = F.concat(F.lit("x"), (F.col("user_id") % 40).cast("string"), F.lit("-"), F.floor(F.col("event_id") / 1000).cast("string"))
    op = F.when(F.col("event_type").isin("view", "click"), "get").otherwise("put")
    w = Window.partitionBy("key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    h = e.select(stretch.alias("key"), "event_id", op.alias("op"), F.when(op == "put", F.concat(F.lit("v"), k.cast("string"))).alias("value"), "k")
    h = h.withColumn("before", F.last("value", ignorenulls=True).over(w))
    null = F.lit(None).cast("string")
    return h.select("key", "op", "value", null.alias("expected"), F.col("before").isNotNull().alias("found"), F.lit(False).alias("swapped"), F.lit(False).alias("failed"), F.when(F.col("op") == "get", F.col("before")).alias("out_value"), null.alias("current"),
                    (F.col("event_id") * 1000).alias("call_ns"), (F.col("event_id") * 1000 + F.col("k") * 15).alias("return_ns"))


@query()
def kv_linearizable(spark, sf):
    return audit.linearizability(_history(spark, sf))


_ANSWERS = "ans AS (SELECT request_id, tenant, item_id AS prompt_id, CASE WHEN k % 41 = 0 THEN 'other' ELSE 'a' || item_id END AS text, CASE WHEN k % 43 = 0 THEN 'Internal' WHEN k % 17 = 0 THEN 'Unavailable' ELSE 'OK' END AS code, 1000 + k * 50 AS elapsed_ms, 3500 AS deadline_ms FROM requests)"


@query(f"""WITH {REQUESTS}, {_ANSWERS}, v AS (SELECT request_id, CASE WHEN code = 'OK' AND text <> 'a' || prompt_id THEN 'wrong answer' WHEN code <> 'OK' AND code NOT IN ('Unavailable', 'DeadlineExceeded', 'ResourceExhausted') THEN 'code is not retryable'
  WHEN elapsed_ms > deadline_ms + 2000 THEN 'hung' END AS violation FROM ans) SELECT * FROM v WHERE violation IS NOT NULL""")
def truth_audit(spark, sf):
    k = F.col("k")
    r = requests(spark, sf)
    right = F.concat(F.lit("a"), F.col("item_id").cast("string"))
    a = r.select("request_id", "tenant", F.col("item_id").alias("prompt_id"), F.when(k % 41 == 0, "other").otherwise(right).alias("text"), F.when(k % 43 == 0, "Internal").when(k % 17 == 0, "Unavailable").otherwise("OK").alias("code"), (1000 + k * 50).alias("elapsed_ms"), F.lit(3500).alias("deadline_ms"))
    return audit.ground_truth(a, r.select("tenant", F.col("item_id").alias("prompt_id"), right.alias("expected")).distinct())


_FAULTS = EVENTS + ", faults AS (SELECT user_id % 20 AS run, event_id AS idx, CASE k % 4 WHEN 0 THEN 'crash' WHEN 1 THEN 'partition' WHEN 2 THEN 'restart' ELSE 'heal' END AS kind, k % 5 AS node FROM ev)"


@query(f"""WITH {_FAULTS}, d AS (SELECT run, idx, CAST(sum(CASE WHEN kind IN ('crash', 'partition') THEN 1 ELSE -1 END) OVER (PARTITION BY run ORDER BY idx) AS BIGINT) AS down FROM faults)
SELECT run, idx, down FROM d WHERE down > 2""")
def nemesis_majority_audit(spark, sf):
    k = F.col("k")
    kind = F.when(k % 4 == 0, "crash").when(k % 4 == 1, "partition").when(k % 4 == 2, "restart").otherwise("heal")
    return audit.majority(events(spark, sf).select((F.col("user_id") % 20).alias("run"), F.col("event_id").alias("idx"), kind.alias("kind"), (k % 5).alias("node")), 5)


@query("SELECT CAST(0 AS BIGINT) AS violations, true AS passed")
def nemesis_schedule(spark, sf):
    return audit.verdict(audit.majority(audit.fault_schedule(spark, 64, 200, 5, seed=42), 5))


@query(f"WITH {EVENTS} SELECT user_id AS log, min(n) AS first, max(n) AS last, count(DISTINCT n) AS entries FROM ev WHERE NOT (user_id % 9 = 0 AND n = 3) GROUP BY user_id HAVING max(n) - min(n) + 1 <> count(DISTINCT n)")
def log_contiguity(spark, sf):
    rows = events(spark, sf).filter("not (user_id % 9 = 0 and n = 3)").withColumn("log", F.col("user_id"))
    return audit.contiguity(rows, "log", "n")


@query(f"WITH {EVENTS} SELECT event_type AS name FROM ev GROUP BY event_type HAVING sum(CASE WHEN k = 9999 THEN 1 ELSE 0 END) <= 0")
def non_vacuity(spark, sf):
    return audit.non_vacuous(events(spark, sf).groupBy(F.col("event_type").alias("name")).agg(F.count_if(F.col("k") == 9999).alias("value")))


@query(f"""WITH {EVENTS}, m AS (SELECT user_id AS leader, n // 5 AS term, row_number() OVER (PARTITION BY user_id, n // 5 ORDER BY k DESC, event_id) AS rank, k AS match_index FROM ev),
held AS (SELECT leader, term, match_index AS held FROM m WHERE rank = 3), log AS (SELECT user_id AS leader, k % 6 AS term, n AS index FROM ev)
SELECT h.leader, h.term, coalesce(max(l.index), 0) AS commit_index FROM held h LEFT JOIN log l ON l.leader = h.leader AND l.term = h.term AND l.index <= h.held GROUP BY h.leader, h.term""")
def raft_commit_index(spark, sf):
    e = events(spark, sf)
    match = e.select(F.col("user_id").alias("leader"), F.expr("n div 5").alias("term"), F.col("k").alias("match_index"))
    return consensus.commit_index(match, e.select(F.col("user_id").alias("leader"), (F.col("k") % 6).alias("term"), F.col("n").alias("index")), 5)


@query(f"""WITH {EVENTS} SELECT event_id, (voted_for = -1 OR voted_for = candidate) AND (k % 3 > k % 4 OR (k % 3 = k % 4 AND n >= k % 50)) AS granted
FROM (SELECT *, CASE WHEN k % 5 = 0 THEN -1 ELSE k % 3 END AS voted_for, user_id % 3 AS candidate FROM ev) t""")
def raft_vote_grants(spark, sf):
    k = F.col("k")
    e = events(spark, sf).select("event_id", F.when(k % 5 == 0, -1).otherwise(k % 3).alias("voted_for"), (F.col("user_id") % 3).alias("candidate"), (k % 3).alias("cand_last_term"), F.col("n").alias("cand_last_index"), (k % 4).alias("last_term"), (k % 50).alias("last_index"))
    return consensus.vote_grants(e).select("event_id", "granted")


@query(f"""WITH {EVENTS}, m AS (SELECT user_id AS pair, n AS index, n // 10 AS term FROM ev), t AS (SELECT user_id AS pair, n AS index, CASE WHEN n > user_id % 30 THEN n // 9 ELSE n // 10 END AS term FROM ev)
SELECT m.pair, min(m.index) AS conflict_index FROM m JOIN t ON m.pair = t.pair AND m.index = t.index WHERE m.term <> t.term GROUP BY m.pair""")
def raft_log_conflict(spark, sf):
    e = events(spark, sf)
    mine = e.select(F.col("user_id").alias("pair"), F.col("n").alias("index"), F.expr("n div 10").alias("term"))
    theirs = e.select(F.col("user_id").alias("pair"), F.col("n").alias("index"), F.when(F.col("n") > F.col("user_id") % 30, F.expr("n div 9")).otherwise(F.expr("n div 10")).alias("term"))
    return consensus.log_conflict(mine, theirs)


@query(f"""WITH {EVENTS}, w AS (SELECT user_id AS peer, n AS index, k * 1000 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY n) AS rn, sum(k * 1000) OVER (PARTITION BY user_id ORDER BY n) AS upto FROM ev)
SELECT peer, index, bytes FROM w WHERE rn = 1 OR (rn <= 20 AND upto <= 700000)""")
def raft_append_batch(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("peer"), F.col("n").alias("index"), (F.col("k") * 1000).alias("bytes"))
    return consensus.append_batch(e, most=20, most_bytes=700_000)


@query(f"""WITH {EVENTS}, m AS (SELECT user_id AS node, event_id AS idx, n // 8 AS term, CASE k % 3 WHEN 0 THEN 'campaign' WHEN 1 THEN 'elected' ELSE 'append' END AS kind FROM ev),
b AS (SELECT *, coalesce(max(term) OVER (PARTITION BY node ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(term) OVER (PARTITION BY node ORDER BY idx) AS current_term FROM m),
c AS (SELECT *, CASE WHEN term > before THEN CASE WHEN kind = 'campaign' THEN 'candidate' ELSE 'follower' END WHEN term = before AND kind = 'elected' THEN 'leader' END AS change FROM b)
SELECT node, idx, current_term, coalesce(last_value(change IGNORE NULLS) OVER (PARTITION BY node ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'follower') AS role FROM c""")
def raft_roles(spark, sf):
    k = F.col("k")
    m = events(spark, sf).select(F.col("user_id").alias("node"), F.col("event_id").alias("idx"), F.expr("n div 8").alias("term"), F.when(k % 3 == 0, "campaign").when(k % 3 == 1, "elected").otherwise("append").alias("kind"))
    return consensus.roles(m).select("node", "idx", "current_term", "role")


_VOTES = "votes AS (SELECT user_id % 30 AS term, user_id AS candidate, event_id AS voter, k % 3 <> 0 AS granted FROM ev WHERE n <= 5)"


@query(f"WITH {EVENTS}, {_VOTES} SELECT term, candidate, 1 + count(*) FILTER (WHERE granted) AS votes, 2 * (1 + count(*) FILTER (WHERE granted)) > 7 AS elected FROM votes GROUP BY term, candidate")
def raft_elections(spark, sf):
    e = events(spark, sf).filter("n <= 5")  # a candidate asks five others
    return consensus.elections(e.select((F.col("user_id") % 30).alias("term"), F.col("user_id").alias("candidate"), (F.col("k") % 3 != 0).alias("granted")), 7)


@query(f"""WITH {EVENTS}, log AS (SELECT user_id AS pair, n AS index, n // 7 AS term FROM ev), c AS (SELECT user_id AS pair, max(n) // 9 AS conflict_term, max(n) // 3 AS conflict_index FROM ev GROUP BY user_id),
l AS (SELECT pair, term, max(index) AS last FROM log GROUP BY pair, term) SELECT c.pair, coalesce(l.last + 1, c.conflict_index) AS next_index FROM c LEFT JOIN l ON l.pair = c.pair AND l.term = c.conflict_term""")
def raft_next_index(spark, sf):
    e = events(spark, sf)
    log = e.select(F.col("user_id").alias("pair"), F.col("n").alias("index"), F.expr("n div 7").alias("term"))
    conflicts = e.groupBy(F.col("user_id").alias("pair")).agg(F.expr("max(n) div 9").alias("conflict_term"), F.expr("max(n) div 3").alias("conflict_index"))
    return consensus.next_index(log, conflicts)


@query(f"WITH {EVENTS} SELECT user_id AS leader, event_id AS arrival, n AS index FROM ev")
def raft_proposed(spark, sf):
    return consensus.proposed(events(spark, sf).select(F.col("user_id").alias("leader"), F.col("event_id").alias("arrival")))


@query(f"""WITH {EVENTS}, w AS (SELECT event_id AS index, k AS term FROM ev), a AS (SELECT event_id AS index, CASE WHEN k % 7 = 0 THEN k + 1 ELSE k END AS term FROM ev WHERE k % 5 <> 0)
SELECT w.index, w.term, CASE WHEN a.term IS NULL THEN 'pending' WHEN a.term = w.term THEN 'ok' ELSE 'ErrLeaderChanged' END AS answer FROM w LEFT JOIN a ON a.index = w.index""")
def raft_waiters(spark, sf):
    k = F.col("k")
    e = events(spark, sf)
    applied = e.filter(k % 5 != 0).select(F.col("event_id").alias("index"), F.when(k % 7 == 0, k + 1).otherwise(k).alias("term"))  # the rest is not applied yet
    return consensus.waiters(e.select(F.col("event_id").alias("index"), k.alias("term")), applied)


@query(f"""WITH {EVENTS} SELECT event_id AS node, CASE WHEN k % 11 = 0 THEN 'NOT_SERVING' WHEN k % 3 = 0 THEN CASE WHEN k % 4 <> 0 THEN 'SERVING' ELSE 'NOT_SERVING' END WHEN k % 5 <> 0 THEN 'SERVING' ELSE 'NOT_SERVING' END AS status FROM ev""")
def raft_health(spark, sf):
    k = F.col("k")
    n = events(spark, sf).select(F.col("event_id").alias("node"), (k % 11 == 0).alias("killed"), (k % 3 == 0).alias("is_leader"), (k % 4 != 0).alias("probe_ok"), (k % 5 != 0).alias("leader_known"))
    return consensus.health(n).select("node", "status")


@query(f"""WITH {EVENTS}, log AS (SELECT user_id AS pair, n AS index, n // 7 AS term FROM ev), ends AS (SELECT pair, max(index) AS last FROM log GROUP BY pair),
q AS (SELECT event_id, user_id AS pair, n + k % 3 AS prev_index, n // 7 AS prev_term, k AS entries, n + 2 AS leader_commit FROM ev),
m AS (SELECT q.*, l.term AS found, e.last FROM q LEFT JOIN log l ON l.pair = q.pair AND l.index = q.prev_index LEFT JOIN ends e ON e.pair = q.pair),
v AS (SELECT *, prev_index = 0 OR coalesce(found = prev_term, false) AS ok FROM m)
SELECT pair, ok AS success, CASE WHEN NOT ok THEN found END AS hint_term, CASE WHEN NOT ok THEN coalesce((SELECT min(index) FROM log l WHERE l.pair = v.pair AND l.term = v.found), last + 1) END AS hint_index,
  CASE WHEN ok THEN least(leader_commit, prev_index + entries) ELSE 0 END AS commit FROM v""")
def raft_append_answers(spark, sf):
    e, k = events(spark, sf), F.col("k")
    log = e.select(F.col("user_id").alias("pair"), F.col("n").alias("index"), F.expr("n div 7").alias("term"))
    asked = e.select(F.col("user_id").alias("pair"), (F.col("n") + k % 3).alias("prev_index"), F.expr("n div 7").alias("prev_term"), k.alias("entries"), (F.col("n") + 2).alias("leader_commit"))
    return consensus.append_answers(log, asked)
