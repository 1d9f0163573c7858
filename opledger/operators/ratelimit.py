"""Token buckets with lazy refill.

Requests have ``tenant, ts_ms, idx, n``; limits ``tenant, rate`` (a second) and
``burst``.  A bucket starts full, never runs backwards, and a refused request
changes nothing.  A decimal rate is multiplied exactly and rounded once, as SQL
does with a decimal literal; a request that finds exactly its tokens depends on it.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opledger.operators.folds import fold

DEFAULT_RATE = 10.0


def effective_limits(tenants: DataFrame, overrides: DataFrame, *, rate: float = DEFAULT_RATE, burst: float = 0.0) -> DataFrame:
    """Each tenant's override or the default; a burst of 0 or less is twice the rate."""
    r, b = F.coalesce(F.col("o.rate"), F.lit(rate)), F.coalesce(F.col("o.burst"), F.lit(burst))
    joined = tenants.select("tenant").distinct().alias("t").join(overrides.alias("o"), F.col("t.tenant") == F.col("o.tenant"), "left")
    return joined.select(F.col("t.tenant").alias("tenant"), r.alias("rate"), F.when(b <= 0, 2 * r).otherwise(b).alias("burst"))


def refill(tokens: Column, last_ms: Column, now_ms: Column, rate: Column, burst: Column) -> Column:
    """Tokens at ``now_ms``; a clock that stands or runs back adds none."""
    return F.when(now_ms > last_ms, F.least(burst, tokens + (now_ms - last_ms) * rate / 1000.0)).otherwise(tokens)


class _Bucket:
    def __init__(self):
        self.tokens, self.last, self.leased, self.expires = None, None, {}, {}


def _gained(ms: int, rate: float | Decimal) -> float:
    return float(ms * rate) / 1000.0


def _refilled(b: _Bucket, row: dict) -> None:
    if b.tokens is None:
        b.tokens, b.last = row["burst"], row["ts_ms"]
    if row["ts_ms"] > b.last:
        b.tokens = min(row["burst"], b.tokens + _gained(row["ts_ms"] - b.last, row["rate"]))
        b.last = row["ts_ms"]


def _take(b: _Bucket, row: dict) -> list[tuple]:
    n = row["n"]
    if n > row["burst"]:
        return [(row["idx"], row["tenant"], False, int(1000 * n / float(row["rate"])))]
    held = (b.tokens, b.last)
    _refilled(b, row)
    if b.tokens < n:
        hint = int(1000 * (n - b.tokens) / float(row["rate"]))
        if held[0] is not None:  # a refusal writes nothing, so not even the time moves
            b.tokens, b.last = held
        else:
            b.tokens = None
        return [(row["idx"], row["tenant"], False, hint)]
    b.tokens -= n
    return [(row["idx"], row["tenant"], True, 0)]


def admit(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests in order of ``ts_ms, idx`` with ``admitted`` and ``retry_after_ms``."""
    return fold(requests.join(limits, "tenant"), ["tenant"], ["ts_ms", "idx"], _Bucket, _take, "idx long, tenant string, admitted boolean, retry_after_ms long")


def admit_leased(requests: DataFrame, limits: DataFrame, *, fraction: float, ttl_ms: int = 1000) -> DataFrame:
    """Admission where each ``gateway`` leases batches of the tenant's bucket.

    A batch is the burst's ``fraction``, rounded down; batches of less than 2, or not
    above the request, switch leasing off.  What an expired lease held is lost.
    """

    def step(b: _Bucket, row: dict) -> list[tuple]:
        size, n, g, now = math.floor(row["burst"] * fraction), row["n"], row["gateway"], row["ts_ms"]
        if n > row["burst"] or size < 2 or size <= n:
            return [(*r, False) for r in _take(b, row)]
        if now >= b.expires.get(g, now):
            b.leased[g] = 0.0
        if b.leased.get(g, 0.0) >= n:
            b.leased[g] -= n
            return [(row["idx"], row["tenant"], True, 0, True)]
        [(_, _, ok, hint)] = _take(b, row)
        if ok:
            whole = math.floor(b.tokens + n)  # of what the bucket held before, leases take whole tokens
            more = max(min(size, whole) - n, 0.0)
            b.tokens -= more
            b.leased[g] = b.leased.get(g, 0.0) + more
            b.expires[g] = now + ttl_ms
        return [(row["idx"], row["tenant"], ok, hint, False)]

    return fold(requests.join(limits, "tenant"), ["tenant"], ["ts_ms", "idx"], _Bucket, step, "idx long, tenant string, admitted boolean, retry_after_ms long, from_lease boolean")


def peek(requests: DataFrame, limits: DataFrame, now_ms: int) -> DataFrame:
    """Tokens of each tenant's bucket at ``now_ms`` after all requests; nothing is taken."""

    def step(b: _Bucket, row: dict) -> list[tuple]:
        _take(b, row)
        b.rate, b.burst = row["rate"], row["burst"]
        return []

    def finish(key: tuple, b: _Bucket) -> list[tuple]:
        if b.tokens is None:
            return [(key[0], b.burst)]
        return [(key[0], min(b.burst, b.tokens + _gained(max(0, now_ms - b.last), b.rate)))]

    return fold(requests.join(limits, "tenant"), ["tenant"], ["ts_ms", "idx"], _Bucket, step, "tenant string, tokens double", finish)


def budget_audit(admitted: DataFrame, requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Per tenant: admitted tokens, the most that burst and rate allow over its span, and whether it keeps to that."""
    span = requests.groupBy("tenant").agg((F.max("ts_ms") - F.min("ts_ms")).alias("span_ms"))
    taken = requests.select("idx", "n").join(admitted, "idx").groupBy("tenant").agg(F.sum(F.when(F.col("admitted"), F.col("n")).otherwise(0)).alias("admitted"))
    out = taken.join(span, "tenant").join(limits, "tenant")
    allowed = F.col("burst") + F.col("rate") * F.col("span_ms") / 1000.0
    return out.select("tenant", "admitted", F.floor(allowed).alias("allowed"), (F.col("admitted") <= allowed).alias("within"))
