"""Shard configurations: rebalancing, ownership, transitions.

A command log has ``idx, op`` (join, leave, move), ``gids`` (array), ``shard`` and
``gid``.  It is a control plane's log: the history is folded in one task, and
everything about keys joins its exploded rows ``(num, idx, shard, gid)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opledger.functions.hashing import SHARDS
from opledger.operators.asof import asof_join, free_name
from opledger.operators.folds import fold


def rebalanced(shards: list[int], gids: list[int]) -> list[int]:
    """Spread shards over groups with the fewest moves.

    Each group's quota is the even share, one more for the lowest ids while the
    division leaves a rest.  Groups above quota give up their lowest shards; those
    and ownerless shards go, in order, to the group with the least shards below
    its quota.
    """
    gids = sorted(gids)
    if not gids:
        return [0] * len(shards)
    share, rest = divmod(len(shards), len(gids))
    quota = {g: share + (k < rest) for k, g in enumerate(gids)}
    owned = {g: [s for s, o in enumerate(shards) if o == g] for g in gids}
    free = [s for s, o in enumerate(shards) if o not in quota]
    for g in gids:
        over = len(owned[g]) - quota[g]
        if over > 0:
            free += owned[g][:over]
            owned[g] = owned[g][over:]
    for s in free:
        owned[min((g for g in gids if len(owned[g]) < quota[g]), key=lambda g: (len(owned[g]), g))].append(s)
    return [next(g for g in gids if s in owned[g]) for s in range(len(shards))]


#: Rows of a configuration history that are broadcast at most.
BROADCAST_HISTORY = 10_000


class _Config:
    def __init__(self):
        self.num, self.shards, self.groups = 0, [0] * SHARDS, set()


def _config_step(c: _Config, row: dict) -> list[tuple]:
    op, error = row["op"], None
    if op == "join":
        c.groups |= set(row["gids"])
        c.shards = rebalanced(c.shards, sorted(c.groups))
    elif op == "leave":
        c.groups -= set(row["gids"])
        c.shards = rebalanced([g if g in c.groups else 0 for g in c.shards], sorted(c.groups))
    elif op == "move":
        if not 0 <= row["shard"] < SHARDS:
            error = "ErrInvalidShard"
        elif row["gid"] not in c.groups:
            error = "ErrUnknownGroup"
        else:
            c.shards = [row["gid"] if s == row["shard"] else g for s, g in enumerate(c.shards)]
    else:
        raise ValueError(f"unknown operation {op}")
    if error is None:
        c.num += 1
    return [(row["idx"], c.num, error, list(c.shards))]


def config_log(commands: DataFrame) -> DataFrame:
    """Each command with the configuration after it, or its error."""
    return fold(commands.withColumn("all", F.lit(0)), ["all"], ["idx"], _Config, _config_step, "idx long, num long, error string, shards array<long>")


def history(commands: DataFrame) -> DataFrame:
    """``(idx, num, shard, gid)`` of every configuration that came to be; a refused move makes none."""
    return config_log(commands).filter("error is null").select("idx", "num", F.posexplode("shards").alias("shard", "gid")).withColumn("shard", F.col("shard").cast("bigint"))


def config_of(history_rows: DataFrame, num: int) -> DataFrame:
    """The configuration of a number; one that is not there means the newest."""
    last = history_rows.agg(F.max("num").alias("last"))
    wanted = F.when((F.lit(num) < 0) | (F.lit(num) > F.col("last")), F.col("last")).otherwise(F.lit(num))
    return history_rows.crossJoin(F.broadcast(last)).filter(F.col("num") == wanted).drop("last")  # one row


def owner_at(ops: DataFrame, history_rows: DataFrame) -> DataFrame:
    """Operations with the configuration number and owner of their shard at their place.

    A history of up to ``BROADCAST_HISTORY`` rows goes to the operations as spans of
    places; a longer one is joined as of the place.
    """
    if history_rows.limit(BROADCAST_HISTORY + 1).count() <= BROADCAST_HISTORY:
        until = F.lead("idx").over(Window.partitionBy("shard").orderBy("idx", "num"))
        begin, end, of = (free_name(x, ops) for x in ("begins", "ends", "of"))
        spans = history_rows.select(F.col("shard").alias(of), F.col("idx").alias(begin), until.alias(end), "num", "gid")
        inside = (F.col("shard") == F.col(of)) & (F.col("idx") >= F.col(begin)) & (F.col(end).isNull() | (F.col("idx") < F.col(end)))
        return ops.join(F.broadcast(spans), inside, "left").drop(of, begin, end)
    return asof_join(ops, history_rows.select("idx", "shard", "num", "gid"), by=["shard"], at="idx", values=["num", "gid"])


def ownership_errors(ops: DataFrame, history_rows: DataFrame, gid: int) -> DataFrame:
    """How a group answers: WrongGroup if it does not own the shard, NotReady until a gained shard has arrived."""
    own = owner_at(ops, history_rows)
    arrived = F.col("arrived")
    gained = transitions(history_rows).filter((F.col("gid") == gid) & (F.col("change") == "gained")).select("idx", "shard", "num", F.col("idx").alias("since"))
    seen = asof_join(own.withColumnRenamed("num", "config"), gained, by=["shard"], at="idx", values=["since"])
    seen = seen.withColumn("arrived", F.col("since").isNull() | (F.col("idx") >= F.col("since") + 10))
    return seen.withColumn("error", F.when(F.coalesce("gid", F.lit(0)) != gid, "ErrWrongGroup").when(~arrived, "ErrNotReady")).drop("arrived", "since")


def transitions(history_rows: DataFrame) -> DataFrame:
    """Per configuration and shard: who had it, who has it, and whether it was gained, lost, handed over or kept."""
    w = Window.partitionBy("shard").orderBy("num")
    prev = F.coalesce(F.lag("gid").over(w), F.lit(0))
    change = F.when(F.col("prev") == F.col("gid"), "kept").when(F.col("prev") == 0, "gained").when(F.col("gid") == 0, "lost").otherwise("gained")
    return history_rows.withColumn("prev", prev).withColumn("change", change)


def last_owner(history_rows: DataFrame) -> DataFrame:
    """The newest real owner before each configuration: where a gained shard's data comes from."""
    w = Window.partitionBy("shard").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    return history_rows.withColumn("pull_from", F.last(F.nullif("gid", F.lit(0)), ignorenulls=True).over(w))


def balance(history_rows: DataFrame) -> DataFrame:
    """Per configuration: groups, most and least shards of a group, and shards that moved."""
    moved = transitions(history_rows).groupBy("num").agg(F.count_if(F.col("prev") != F.col("gid")).alias("moved"))
    per = history_rows.filter("gid <> 0").groupBy("num", "gid").agg(F.count("*").alias("n")).groupBy("num").agg(F.count("*").alias("groups"), F.max("n").alias("most"), F.min("n").alias("least"))
    return per.join(moved, "num")


def migrations(installs: DataFrame, history_rows: DataFrame) -> DataFrame:
    """Installs ``(idx, shard, at_config)`` that count: the first for a shard gained in exactly that configuration."""
    needed = transitions(history_rows).filter("change = 'gained' and prev <> 0").select("shard", F.col("num").alias("at_config"))
    w = Window.partitionBy("shard", "at_config").orderBy("idx")
    marked = installs.join(needed.withColumn("needed", F.lit(True)), ["shard", "at_config"], "left")
    return marked.withColumn("accepted", F.coalesce("needed", F.lit(False)) & (F.row_number().over(w) == 1)).drop("needed")
