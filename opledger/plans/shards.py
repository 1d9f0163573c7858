"""Queries over shards and their configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from opledger.functions.hashing import shard_of
from opledger.operators import kv, shards
from opledger.plans.book import Book
from opledger.plans.inputs import OPLOG, oplog

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle

#: The command log of the queries, one command each ``STEP`` operations.
COMMANDS = (("join", [1, 2, 3], 0, 0), ("join", [4], 0, 0), ("move", [], 0, 4), ("move", [], 99, 4), ("leave", [2], 0, 0), ("move", [], 1, 9), ("join", [5, 6, 7, 8], 0, 0), ("leave", [1, 3, 4], 0, 0))
STEP = 100


def commands(spark):
    rows = [(k * STEP, op, gids, shard, gid) for k, (op, gids, shard, gid) in enumerate(COMMANDS)]
    return spark.createDataFrame(rows, "idx long, op string, gids array<long>, shard long, gid long")


def config_history(spark):
    return shards.history(commands(spark))


#: The configurations that the commands make, worked out by hand from the rule: place of the command, number, owners of shards 0 to 9.
#: Quotas are the even share, one more for the lowest groups; groups above quota give up their lowest shards, in order of groups, to the group with the least.
OWNERS = (
    (0, 1, (1, 2, 3, 1, 2, 3, 1, 2, 3, 1)),  # quotas 4, 3, 3; all are free
    (100, 2, (4, 2, 4, 1, 2, 3, 1, 2, 3, 1)),  # quotas 3, 3, 2, 2: group 1 gives up shard 0, group 3 shard 2, both to 4
    (200, 3, (4, 2, 4, 1, 2, 3, 1, 2, 3, 1)),  # shard 0 is group 4's already; the move is a configuration all the same
    (400, 4, (4, 3, 4, 1, 4, 3, 1, 1, 3, 1)),  # the shard 99 was refused; of quotas 4, 3, 3: shard 1 to 3, 4 to 4, 7 to 1
    (600, 5, (8, 7, 4, 5, 4, 3, 6, 1, 3, 1)),  # group 9 was refused; quotas 2, 2, 2, 1, 1, 1, 1: shards 3, 6 of 1, 1 of 3, 0 of 4 to 5, 6, 7, 8
    (700, 6, (8, 7, 5, 5, 6, 7, 6, 8, 5, 6)),  # quotas 3, 3, 2, 2: shards 2, 4, 5, 7, 8, 9 to 5, 6, 7, 8, 5, 6
)
HIST = "hist(idx, num, shard, gid) AS (VALUES " + ", ".join(f"({idx}, {num}, {s}, {g})" for idx, num, owners in OWNERS for s, g in enumerate(owners)) + ")"
_BYTES = "list_transform(range(0, octet_length(encode(key))), lambda i: CAST(('0x' || substr(hex(encode(key)), CAST(2 * i + 1 AS INT), 2)) AS BIGINT))"
_SHARD = f"list_reduce({_BYTES}, lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261) % 10"
_SHARDED = f"sharded AS (SELECT *, CAST({_SHARD} AS BIGINT) AS shard FROM oplog)"
_TRANS = "trans AS (SELECT *, CASE WHEN prev = gid THEN 'kept' WHEN prev = 0 THEN 'gained' WHEN gid = 0 THEN 'lost' ELSE 'gained' END AS change FROM (SELECT *, coalesce(lag(gid) OVER (PARTITION BY shard ORDER BY num), 0) AS prev FROM hist) h)"


def _ops(spark, sf):
    return oplog(spark, sf).withColumn("shard", shard_of(F.col("key")))


@query(f"WITH {OPLOG}, {_SHARDED} SELECT DISTINCT key, shard FROM sharded")
def shard_of_key(spark, sf):
    keys = oplog(spark, sf).select("key").distinct()
    return keys.select("key", shard_of(F.col("key")).alias("shard"))


@query(f"WITH {OPLOG}, {_SHARDED} SELECT shard, op, count(*) AS n FROM sharded GROUP BY shard, op")
def shard_op_counts(spark, sf):
    return _ops(spark, sf).groupBy("shard", "op").agg(F.count("*").alias("n"))


@query(f"WITH {OPLOG}, {_SHARDED}, {HIST} SELECT s.idx, s.shard, h.num, h.gid FROM sharded s ASOF LEFT JOIN hist h ON s.shard = h.shard AND s.idx >= h.idx")
def shard_config_at_op(spark, sf):
    return shards.owner_at(_ops(spark, sf), config_history(spark)).select("idx", "shard", "num", "gid")


@query(f"""WITH {OPLOG}, {_SHARDED}, {HIST}, {_TRANS}, own AS (SELECT s.idx, s.shard, h.gid FROM sharded s ASOF LEFT JOIN hist h ON s.shard = h.shard AND s.idx >= h.idx),
gained AS (SELECT idx AS since, shard FROM trans WHERE gid = 5 AND change = 'gained'), both_ AS (SELECT o.*, g.since FROM own o ASOF LEFT JOIN gained g ON o.shard = g.shard AND o.idx >= g.since)
SELECT coalesce(error, 'ok') AS answer, count(*) AS n FROM (SELECT CASE WHEN coalesce(gid, 0) <> 5 THEN 'ErrWrongGroup' WHEN NOT (since IS NULL OR idx >= since + 10) THEN 'ErrNotReady' END AS error FROM both_) t GROUP BY 1""")
def shard_ownership_errors(spark, sf):
    return shards.ownership_errors(_ops(spark, sf), config_history(spark), 5).groupBy(F.coalesce("error", F.lit("ok")).alias("answer")).agg(F.count("*").alias("n"))


@query(f"WITH {HIST}, {_TRANS} SELECT num, shard, prev, gid, change FROM trans")
def shard_gain_loss(spark, sf):
    return shards.transitions(config_history(spark)).select("num", "shard", "prev", "gid", "change")


@query(f"WITH {HIST} SELECT num, shard, gid, last_value(nullif(gid, 0) IGNORE NULLS) OVER (PARTITION BY shard ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pull_from FROM hist")
def shard_last_owner(spark, sf):
    return shards.last_owner(config_history(spark)).select("num", "shard", "gid", "pull_from")


@query(f"""WITH {HIST}, {_TRANS}, per AS (SELECT num, count(*) AS groups, max(n) AS most, min(n) AS least FROM (SELECT num, gid, count(*) AS n FROM hist WHERE gid <> 0 GROUP BY num, gid) g GROUP BY num)
SELECT p.*, (SELECT count(*) FROM trans t WHERE t.num = p.num AND t.prev <> t.gid) AS moved FROM per p""")
def shard_balance(spark, sf):
    return shards.balance(config_history(spark)).select("num", "groups", "most", "least", "moved")


@query(f"WITH {HIST} SELECT num, string_agg(gid, ',' ORDER BY shard) AS owners FROM hist GROUP BY num")
def shard_rebalance_history(spark, sf):
    return shards.config_log(commands(spark)).filter("error is null").select("num", F.array_join(F.col("shards").cast("array<string>"), ",").alias("owners"))


@query(f"""WITH {HIST}, {_TRANS}, installs AS (SELECT i AS idx, i % 10 AS shard, 2 + i % 5 AS at_config FROM range(60) r(i))
SELECT i.idx, i.shard, i.at_config, n.shard IS NOT NULL AND row_number() OVER (PARTITION BY i.shard, i.at_config ORDER BY i.idx) = 1 AS accepted
FROM installs i LEFT JOIN (SELECT shard, num FROM trans WHERE change = 'gained' AND prev <> 0) n ON n.shard = i.shard AND n.num = i.at_config""")
def shard_migration_installs(spark, sf):
    installs = spark.range(60).select(F.col("id").alias("idx"), (F.col("id") % 10).alias("shard"), (F.col("id") % 5 + 2).alias("at_config"))
    return shards.migrations(installs, config_history(spark)).select("idx", "shard", "at_config", "accepted")


@query(f"""WITH {OPLOG}, {_SHARDED}, per AS (SELECT *, CASE WHEN newer IS NULL OR request_id > newer THEN 'applied' WHEN request_id = newer THEN 'duplicate' ELSE 'stale' END AS class2
FROM (SELECT *, max(request_id) OVER (PARTITION BY shard, client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer FROM sharded) t)
SELECT shard, class2 AS class, count(*) AS n FROM per GROUP BY shard, class2""")
def shard_dedup_classes(spark, sf):
    return kv.classify(_ops(spark, sf), by=("shard", "client_id")).groupBy("shard", "class").agg(F.count("*").alias("n"))


@query(f"WITH {HIST} SELECT 0 AS wanted, num, shard, gid FROM hist WHERE num = 6 UNION ALL SELECT 3, num, shard, gid FROM hist WHERE num = 3 UNION ALL SELECT 99, num, shard, gid FROM hist WHERE num = 6")
def shard_config_of(spark, sf):
    """The newest configuration by a negative and a too large number, and one by its own."""
    h = config_history(spark)
    pick = lambda n, label: shards.config_of(h, n).select(F.lit(label).alias("wanted"), "num", "shard", "gid")
    return pick(-1, 0).unionByName(pick(3, 3)).unionByName(pick(99, 99))
