"""Replicated-log rules over recorded traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote_grants(requests: DataFrame) -> DataFrame:
    """Whether each vote ``(voted_for, candidate, cand_last_term, cand_last_index, last_term, last_index)`` is granted."""
    free = F.col("voted_for").isin(-1) | (F.col("voted_for") == F.col("candidate"))
    fresh = F.struct("cand_last_term", "cand_last_index") >= F.struct("last_term", "last_index")
    return requests.withColumn("granted", free & fresh)


def elections(votes: DataFrame, nodes: int) -> DataFrame:
    """Candidates of a term that have a majority of the cluster, their own vote counted."""
    return votes.groupBy("term", "candidate").agg((F.count_if("granted") + 1).alias("votes")).withColumn("elected", F.col("votes") * 2 > nodes)


def commit_index(match: DataFrame, log: DataFrame, nodes: int) -> DataFrame:
    """Per leader the largest index that a majority holds and whose entry is of the leader's own term; 0 if none.

    ``match`` has ``leader, term, match_index`` of every node, the leader's own too;
    the index that a majority holds is an order statistic.
    """
    majority = nodes // 2 + 1
    w = Window.partitionBy("leader", "term").orderBy(F.desc("match_index"))
    held = match.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == majority).select("leader", "term", F.col("match_index").alias("held"))
    own = log.select(F.col("leader").alias("l"), F.col("term").alias("entry_term"), "index")
    able = held.join(own, (F.col("leader") == F.col("l")) & (F.col("entry_term") == F.col("term")) & (F.col("index") <= F.col("held")), "left")
    return able.groupBy("leader", "term").agg(F.coalesce(F.max("index"), F.lit(0)).alias("commit_index"))


def log_conflict(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """First index of each pair of logs ``(pair, index, term)`` at which their terms differ or only ``theirs`` has an entry.

    ``mine`` is the follower's: from a differing term it truncates, from its end it
    appends.  Entries that the leader does not send are no conflict.
    """
    ours = mine.select("pair", "index", F.col("term").alias("own_term"))
    both = theirs.join(ours, ["pair", "index"], "left")
    return both.filter(~F.col("term").eqNullSafe(F.col("own_term"))).groupBy("pair").agg(F.min("index").alias("conflict_index"))


def append_answers(follower: DataFrame, requests: DataFrame) -> DataFrame:
    """How followers ``(pair, index, term)`` answer requests ``(pair, prev_index, prev_term, entries, leader_commit)``.

    ``success`` if the entry before is there with its term (index 0 is always).  Else
    ``hint_term`` and ``hint_index`` say where to go on: the first index of the term
    found in its place, or the place behind the log's end with a null term.
    ``commit`` is what the leader has committed, up to the last entry sent; 0 on failure.
    """
    ends = follower.groupBy("pair").agg(F.max("index").alias("last"))
    firsts = follower.groupBy("pair", "term").agg(F.min("index").alias("first"))
    at = follower.select("pair", F.col("index").alias("prev_index"), F.col("term").alias("found"))
    r = requests.join(ends, "pair", "left").join(at, ["pair", "prev_index"], "left").join(firsts.withColumnRenamed("term", "found"), ["pair", "found"], "left")
    ok = (F.col("prev_index") == 0) | F.coalesce(F.col("found") == F.col("prev_term"), F.lit(False))
    return r.select("pair", ok.alias("success"), F.when(~ok, F.col("found")).alias("hint_term"), F.when(~ok, F.coalesce("first", F.coalesce("last", F.lit(0)) + 1)).alias("hint_index"),
        F.when(ok, F.least("leader_commit", F.col("prev_index") + F.col("entries"))).otherwise(0).alias("commit"))


def next_index(log: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Where a leader goes on after a conflict ``(pair, conflict_term, conflict_index)``: behind its last entry of that term, else at the index."""
    last = log.groupBy("pair", "term").agg(F.max("index").alias("last"))
    both = conflicts.join(last, (conflicts.pair == last.pair) & (conflicts.conflict_term == last.term), "left")
    return both.select(conflicts.pair, F.coalesce(F.col("last") + 1, F.col("conflict_index")).alias("next_index"))


def append_batch(entries: DataFrame, *, most: int = 512, most_bytes: int = 4 << 20) -> DataFrame:
    """The leading entries ``(peer, index, bytes)`` that one message takes: up to both limits, one at least."""
    w = Window.partitionBy("peer").orderBy("index")
    upto = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(w)
    return entries.withColumn("n", n).withColumn("upto", upto).filter((F.col("n") == 1) | (F.col("n") <= most) & (F.col("upto") <= most_bytes)).drop("n", "upto")


def proposed(rows: DataFrame, by: str = "leader", order: str = "arrival") -> DataFrame:
    """Index of each proposal in its leader's log."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("bigint"))


def waiters(waiting: DataFrame, applied: DataFrame) -> DataFrame:
    """Proposals waiting at ``(index, term)``: answered, overtaken by another term, or still pending."""
    a = applied.select(F.col("index").alias("i"), F.col("term").alias("applied_term"))
    both = waiting.join(a, waiting["index"] == a["i"], "left")
    return both.withColumn("answer", F.when(F.col("applied_term").isNull(), "pending").when(F.col("applied_term") == F.col("term"), "ok").otherwise("ErrLeaderChanged")).drop("i", "applied_term")


def roles(messages: DataFrame) -> DataFrame:
    """Node messages ``(node, idx, term, kind)`` with the newest term so far and the role: a higher term makes a follower."""
    w = Window.partitionBy("node").orderBy("idx")
    before = F.coalesce(F.max("term").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = messages.withColumn("current_term", F.max("term").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = F.when(F.col("term") > before, F.when(F.col("kind") == "campaign", "candidate").otherwise("follower")).when((F.col("term") == before) & (F.col("kind") == "elected"), "leader")
    return rows.withColumn("role", F.coalesce(F.last(change, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("follower")))


def health(nodes: DataFrame) -> DataFrame:
    """``SERVING`` for a live leader that answers its probe, or a live follower that knows a leader."""
    ok = ~F.col("killed") & F.when(F.col("is_leader"), F.col("probe_ok")).otherwise(F.col("leader_known"))
    return nodes.withColumn("status", F.when(ok, "SERVING").otherwise("NOT_SERVING"))
