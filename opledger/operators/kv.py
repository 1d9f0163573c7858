"""Key-value state machine over an ordered operation log.

A log has ``idx`` (the total order), ``key``, ``client_id``, ``request_id``, ``op``
(PUT, GET, DELETE, CAS), ``value``, ``expected`` and ``expect_absent``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opledger.operators.folds import fold

BEFORE = (Window.unboundedPreceding, -1)


def classify(log: DataFrame, *, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Add ``class``: applied, duplicate (of the client's newest request) or stale (older).

    A null or empty client is never deduplicated.  Rows that are not applied never
    exceed the running maximum, so the maximum over all earlier rows will do.
    """
    anonymous = F.coalesce(F.col("client_id"), F.lit("")) == ""
    w = Window.partitionBy(*by, F.when(anonymous, F.col("idx"))).orderBy("idx").rowsBetween(*BEFORE)
    newest = F.max("request_id").over(w)
    return log.withColumn("class", F.when(anonymous | newest.isNull() | (F.col("request_id") > newest), "applied").when(F.col("request_id") == newest, "duplicate").otherwise("stale"))


def applied(log: DataFrame, *, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    return classify(log, by=by).filter("class = 'applied'").drop("class")


def write_errors(log: DataFrame) -> DataFrame:
    """Rows with the error a caller sees: an empty key, or a stale request."""
    return classify(log).withColumn("error", F.when(F.coalesce("key", F.lit("")) == "", "InvalidArgument").when(F.col("class") == "stale", "FailedPrecondition"))


def state(log: DataFrame) -> DataFrame:
    """Live keys after a log without CAS: the last PUT or DELETE of each key decides."""
    last = log.filter("op in ('PUT', 'DELETE')").groupBy("key").agg(F.max_by(F.struct("op", "value"), "idx").alias("last"))
    return last.filter("last.op = 'PUT'").select("key", F.col("last.value").alias("value"))


def existed(log: DataFrame) -> DataFrame:
    """DELETE rows with whether their key was there; of a log without CAS."""
    w = Window.partitionBy("key").orderBy("idx")
    return log.filter("op in ('PUT', 'DELETE')").withColumn("existed", F.coalesce(F.lag("op").over(w) == "PUT", F.lit(False))).filter("op = 'DELETE'").select("idx", "key", "existed")


def reads(log: DataFrame) -> DataFrame:
    """GET rows with the value as of their place in the log; of a log without CAS."""
    w = Window.partitionBy("key").orderBy("idx").rowsBetween(*BEFORE)
    last = F.last(F.when(F.col("op").isin("PUT", "DELETE"), F.struct("op", "value")), ignorenulls=True).over(w)
    out = log.withColumn("last", last).filter("op = 'GET'").withColumn("found", F.coalesce(F.col("last.op") == "PUT", F.lit(False)))
    return out.select("idx", "key", "found", F.when(F.col("found"), F.col("last.value")).alias("value"))


def results(log: DataFrame) -> DataFrame:
    """Every classified row's ``result`` text: a duplicate has the result of the client's last applied request."""
    told = classify(log)
    ok = told.filter("class = 'applied'")
    shown = existed(ok).select("idx", F.concat(F.lit("existed="), F.col("existed").cast("string")).alias("result"))
    shown = shown.unionByName(reads(ok).select("idx", F.coalesce(F.concat(F.lit("value="), "value"), F.lit("absent")).alias("result")))
    w = Window.partitionBy("client_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    with_own = told.join(shown, "idx", "left").withColumn("own", F.when(F.col("class") == "applied", F.coalesce("result", F.lit("ok"))))
    return with_own.withColumn("result", F.when(F.col("class") != "stale", F.last("own", ignorenulls=True).over(w))).drop("own")


class _Cell:
    __slots__ = ("value",)

    def __init__(self):
        self.value = None


def _cas_step(cell: _Cell, row: dict) -> list[tuple]:
    op, before = row["op"], cell.value
    if op == "PUT":
        cell.value = row["value"]
    elif op == "DELETE":
        cell.value = None
    elif op == "CAS":
        swap = before is None if row["expect_absent"] else before is not None and before == row["expected"]
        if swap:
            cell.value = row["value"]
        return [(row["idx"], row["key"], swap, before)]
    elif op != "GET":
        raise ValueError(f"unknown operation {op}")
    return []


def cas_outcomes(log: DataFrame) -> DataFrame:
    """CAS rows with ``swapped`` and the value before (null if absent), over an applied log."""
    return fold(log, ["key"], ["idx"], _Cell, _cas_step, "idx long, key string, swapped boolean, current string")


def cas_state(log: DataFrame) -> DataFrame:
    """Live keys after an applied log with CAS."""

    def step(cell: _Cell, row: dict) -> list[tuple]:
        _cas_step(cell, row)
        return []

    return fold(log, ["key"], ["idx"], _Cell, step, "key string, value string", lambda key, cell: [] if cell.value is None else [(key[0], cell.value)])


def cas_outcomes_by_hof(log: DataFrame) -> DataFrame:
    """:func:`cas_outcomes` inside the JVM, for keys whose rows fit one row of an array."""
    start = F.struct(F.lit(None).cast("string").alias("v"), F.array().cast("array<struct<idx:bigint,swapped:boolean,current:string>>").alias("out"))

    def step(s, r):
        swap = (r["op"] == "CAS") & F.when(r["expect_absent"], s["v"].isNull()).otherwise(F.coalesce(s["v"] == r["expected"], F.lit(False)))
        after = F.when((r["op"] == "PUT") | swap, r["value"]).when(r["op"] == "DELETE", F.lit(None).cast("string")).otherwise(s["v"])
        got = F.when(r["op"] == "CAS", F.concat(s["out"], F.array(F.struct(r["idx"].alias("idx"), swap.alias("swapped"), s["v"].alias("current"))))).otherwise(s["out"])
        return F.struct(after.alias("v"), got.alias("out"))

    rows = F.array_sort(F.collect_list(F.struct("idx", "op", "value", "expected", "expect_absent")))
    return log.groupBy("key").agg(F.aggregate(rows, start, step)["out"].alias("out")).select("key", F.explode("out").alias("o")).select("o.idx", "key", "o.swapped", "o.current")


def snapshot_and_tail(log: DataFrame, at: int) -> DataFrame:
    """State from the snapshot at ``idx <= at`` and the log behind it; ``log`` without CAS and applied."""
    snap = state(log.filter(F.col("idx") <= at)).select(F.lit(at).cast("long").alias("idx"), "key", F.lit("PUT").alias("op"), "value")
    return state(snap.unionByName(log.filter(F.col("idx") > at).select("idx", "key", "op", "value")))


def redelivery_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("delivered"), F.count_distinct("client_id", "request_id").alias("distinct_requests"), F.count_distinct("client_id").alias("identities")).withColumn("duplicates", F.col("delivered") - F.col("distinct_requests"))


def batch_stats(log: DataFrame, *, window_ms: int, cap: int = 512) -> DataFrame:
    """Group commit over arrival time: batches of a window's rows, ``cap`` at most, and entries per batch."""
    slot = F.floor(F.col("ts_ms") / window_ms)
    n = log.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.ceil(F.col("n") / cap)).cast("long").alias("batches"), F.sum("n").alias("entries"))
