"""Worker registry and placement by rendezvous hashing.

Workers have ``id, inflight, lease_until_ms`` and are a control plane's list; its
size is checked before it is broadcast.  Requests have ``request_id, prompt, ts_ms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opledger.functions.hashing import rendezvous_order
from opledger.operators.folds import fold
from opledger.shipping import ship

PREFIX_RUNES = 256
#: Workers that are broadcast at most; a larger fleet is joined by shuffle.
BROADCAST_WORKERS = 10_000


def registry(registrations: DataFrame) -> DataFrame:
    """Newest registration of each worker by ``idx``; a registration whose lease is null takes the worker off."""
    last = registrations.groupBy("id").agg(F.max_by(F.struct("inflight", "lease_until_ms"), "idx").alias("last"))
    return last.select("id", "last.inflight", "last.lease_until_ms").filter("lease_until_ms is not null")


def live(workers: DataFrame, now_ms: Column) -> DataFrame:
    """Workers whose lease ends after ``now_ms``; one that ends at it is gone."""
    return workers.filter(F.col("lease_until_ms") > now_ms)


def prefix(prompt: Column, runes: int = PREFIX_RUNES) -> Column:
    return F.substring(prompt, 1, runes if runes > 0 else PREFIX_RUNES)


def ranked(prompts: DataFrame, workers: DataFrame, *, by: str = "prompt", runes: int = PREFIX_RUNES) -> DataFrame:
    """Every worker's ``rank`` for each distinct prefix, best score first, ties by id."""
    ship(prompts.sparkSession)
    fleet = F.broadcast(workers) if workers.limit(BROADCAST_WORKERS + 1).count() <= BROADCAST_WORKERS else workers
    pairs = prompts.select(prefix(F.col(by), runes).alias("prefix")).distinct().join(fleet, F.lit(True))
    w = Window.partitionBy("prefix").orderBy(F.desc("score"), "id")
    return pairs.withColumn("score", rendezvous_order("prefix", "id")).withColumn("rank", F.row_number().over(w)).drop("score")


def pick(ranks: DataFrame, max_inflight: int, *, exclude: tuple[str, ...] = ()) -> DataFrame:
    """First ranked worker below ``max_inflight`` (0: no limit), else the first ranked."""
    able = (F.col("inflight") < max_inflight) if max_inflight > 0 else F.lit(True)
    return ranks.filter(~F.col("id").isin(*exclude)).groupBy("prefix").agg(F.min_by("id", F.struct(~able, "rank")).alias("worker"))


def bound(workers: DataFrame, factor: float) -> DataFrame:
    """One row: the load that no worker may reach, the mean with the new request times ``factor``, rounded up."""
    return workers.agg(F.ceil(F.lit(factor) * (F.sum("inflight") + 1) / F.count("*")).alias("bound"))


def pick_bounded(ranks: DataFrame, workers: DataFrame, factor: float) -> DataFrame:
    """First ranked worker below the bound, else the first ranked."""
    limits = F.broadcast(bound(workers, factor))  # one row
    return ranks.join(limits, F.lit(True)).groupBy("prefix").agg(F.min_by("id", F.struct(F.col("inflight") >= F.col("bound"), F.col("rank"))).alias("worker"))


def least_loaded(workers: DataFrame) -> DataFrame:
    return workers.agg(F.min_by("id", F.struct("inflight", "id")).alias("worker"))


def local_load(reports: DataFrame) -> DataFrame:
    """``estimate``: the reported load less what was local when that report came, plus what is local now.

    A report is known by its lease; ``local`` is the gateway's own count in order of ``ts_ms``.
    """
    w = Window.partitionBy("id", "lease_until_ms").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    return reports.withColumn("estimate", F.greatest(F.lit(0), F.col("inflight") - F.first("local").over(w)) + F.col("local"))


def disruption(before: DataFrame, after: DataFrame, removed: str) -> DataFrame:
    """How many prefixes moved when a worker left, and how many of them were not its own."""
    moved = F.col("b.worker") != F.col("a.worker")
    both = before.alias("b").join(after.alias("a"), "prefix")
    return both.agg(F.count("*").alias("prefixes"), F.count_if(moved).alias("moved"), F.count_if(moved & (F.col("b.worker") != removed)).alias("moved_elsewhere"))


def place_in_order(requests: DataFrame, ranks: DataFrame, factor: float) -> DataFrame:
    """Bounded placement where each placement loads its worker, one request after another.

    Each request's load depends on all before it, so requests are placed within
    ``lane``: one gateway's stream, which alone sees its own placements.
    """
    orders = ranks.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "inflight"))), lambda x: F.struct(x["id"].alias("id"), x["inflight"].alias("inflight"))).alias("order"))
    rows = requests.join(orders, "prefix").select("lane", "request_id", "order")

    def step(load: dict, row: dict) -> list[tuple]:
        for w in row["order"]:
            load.setdefault(w["id"], w["inflight"])
        ids = [w["id"] for w in row["order"]]
        limit = -(-factor * (sum(load[i] for i in ids) + 1) // len(ids))
        worker = next((i for i in ids if load[i] < limit), ids[0])
        load[worker] += 1
        return [(row["lane"], row["request_id"], worker)]

    return fold(rows, ["lane"], ["request_id"], dict, step, "lane long, request_id long, worker string")
