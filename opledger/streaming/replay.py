"""Streams of operations and requests.

The batch operators' step functions run with a state per key; within a micro-batch
a key's rows are sorted first, and batches follow the order of the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from opledger.operators.ratelimit import _Bucket, _take
from opledger.shipping import ship


def classify(log: DataFrame) -> DataFrame:
    """Streaming deduplication by client: the state is the client's newest applied request."""
    ship(log.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(parts).sort_values("idx")
        told = []
        for r in rows["request_id"]:
            if not key[0] or newest is None or r > newest:
                told.append("applied")
                newest = r if key[0] else newest
            else:
                told.append("duplicate" if r == newest else "stale")
        if newest is not None:
            state.update((int(newest),))
        yield pd.DataFrame({"idx": rows["idx"], "client_id": rows["client_id"], "request_id": rows["request_id"], "class": told})

    return log.groupBy("client_id").applyInPandasWithState(step, "idx long, client_id string, request_id long, class string", "newest long", "append", "NoTimeout")


def admit(requests: DataFrame) -> DataFrame:
    """Streaming token buckets of requests ``(idx, tenant, ts_ms, n, rate, burst)``."""
    ship(requests.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = _Bucket()
        if state.exists:
            b.tokens, b.last = state.get
        out = []
        for row in pd.concat(parts).sort_values(["ts_ms", "idx"]).to_dict("records"):
            out += _take(b, row)
        if b.tokens is not None:
            state.update((float(b.tokens), int(b.last)))
        yield pd.DataFrame(out, columns=["idx", "tenant", "admitted", "retry_after_ms"])

    return requests.groupBy("tenant").applyInPandasWithState(step, "idx long, tenant string, admitted boolean, retry_after_ms long", "tokens double, last_ms long", "append", "NoTimeout")


def first_submits(submits: DataFrame, *, within: str = "30 seconds") -> DataFrame:
    """First submit of each key; repeats are known for the reservation's time to live. Needs ``ts``."""
    return submits.withWatermark("ts", within).dropDuplicatesWithinWatermark(["prefix", "idem_key"])


def rate(rows: DataFrame, label: str, *, window: str = "1 minute", slide: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Events a second over sliding windows of event time ``ts``."""
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    counts = rows.withWatermark("ts", late).groupBy(F.window("ts", window, slide), label).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.end").alias("end"), label, (F.col("n") / seconds).alias("rate"))


def sessions(rows: DataFrame, by: str, *, gap: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """Runs of events of ``by`` with no longer gap between them."""
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
