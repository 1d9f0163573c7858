"""Audits of recorded histories: linearizability, ground truth, faults, contiguity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opledger.operators.folds import fold
from opledger.shipping import ship

RETRYABLE = ("Unavailable", "DeadlineExceeded", "ResourceExhausted")


def model_step(value: str | None, op: dict) -> list[str | None] | None:
    """States a register may have after an operation, or None if its result is impossible.

    A failed write may or may not have happened; a failed read says nothing.
    """
    kind = op["op"]
    if kind == "get":
        return [value] if op["failed"] or (op["out_value"] if op["found"] else None) == value else None
    if kind == "put":
        return [op["value"], value] if op["failed"] else [op["value"]]
    if kind != "cas":
        raise ValueError(f"unknown operation {kind}")
    fits = value == op["expected"]
    if op["failed"]:
        return [op["value"], value] if fits else [value]
    if op["swapped"] != fits or op["current"] != value:
        return None
    return [op["value"]] if fits else [value]


def _reachable(ops: list[dict], starts: set, budget: int) -> tuple[set, int]:
    """States after all of some operations in any legal order, and the steps the search took.

    Depth-first over (operations placed, state); an operation may come next if no
    unplaced one returned before it was called.
    """
    ops = sorted(ops, key=lambda o: (o["call_ns"], o["return_ns"]))
    n, full = len(ops), (1 << len(ops)) - 1
    stack = [(0, s) for s in starts]
    seen, ends, steps = set(stack), set(), 0
    while stack and steps <= budget:
        placed, value = stack.pop()
        if placed == full:
            ends.add(value)
            continue
        steps += 1
        open_ = [k for k in range(n) if not placed >> k & 1]
        first_return = min(ops[k]["return_ns"] for k in open_)
        for k in open_:
            if ops[k]["call_ns"] > first_return:
                break
            for after in model_step(value, ops[k]) or ():
                if (new := (placed | 1 << k, after)) not in seen:
                    seen.add(new)
                    stack.append(new)
    return ends, steps


class _Search:
    def __init__(self):
        self.states, self.open, self.until, self.ops, self.steps, self.verdict = {None}, [], None, 0, 0, "ok"

    def close(self, budget: int) -> None:
        if self.open and self.verdict == "ok":
            self.states, steps = _reachable(self.open, self.states, budget - self.steps)
            self.steps += steps
            self.verdict = "unknown" if self.steps > budget else "ok" if self.states else "violation"
        self.open = []


def linearizability(history: DataFrame, *, budget: int = 200_000) -> DataFrame:
    """Verdict of each key of a history ``(key, op, value, expected, found, swapped, failed, out_value, current, call_ns, return_ns)``.

    ``ok`` if a legal order respects the intervals, else ``violation``; ``unknown``
    beyond ``budget`` steps.  Keys are independent, and a moment at which nothing
    runs cuts a key's history: only the states possible there are carried on, so a
    task holds the operations between two such moments.
    """

    def step(s: _Search, row: dict) -> list[tuple]:
        if s.until is not None and row["call_ns"] > s.until:
            s.close(budget)
        s.open.append(row)
        s.ops += 1
        s.until = max(row["return_ns"], s.until or row["return_ns"])
        return []

    def finish(key: tuple, s: _Search) -> list[tuple]:
        s.close(budget)
        return [(key[0], s.ops, s.verdict)]

    return fold(history, ["key"], ["call_ns", "return_ns"], _Search, step, "key string, ops long, verdict string", finish)


def retryable(code: str):
    return F.col(code).isin(*RETRYABLE)


def ground_truth(answers: DataFrame, truth: DataFrame, *, slack_ms: int = 2000) -> DataFrame:
    """Violations of answers ``(request_id, tenant, prompt_id, text, code, elapsed_ms, deadline_ms)`` against ``truth (tenant, prompt_id, expected)``."""
    both = answers.join(truth, ["tenant", "prompt_id"], "left")
    ok = F.col("code") == "OK"
    bad = F.when(ok & (F.col("expected").isNull() | (F.col("text") != F.col("expected"))), "wrong answer").when(~ok & ~retryable("code"), "code is not retryable").when(F.col("elapsed_ms") > F.col("deadline_ms") + slack_ms, "hung")
    return both.select("request_id", bad.alias("violation")).filter("violation is not null")


def majority(events: DataFrame, nodes: int) -> DataFrame:
    """Fault events ``(run, idx, kind, node)`` after which a majority of nodes is down; crash and partition take one down, restart and heal bring it back."""
    w = Window.partitionBy("run").orderBy("idx")
    delta = F.when(F.col("kind").isin("crash", "partition"), 1).when(F.col("kind").isin("restart", "heal"), -1).otherwise(0)
    return events.withColumn("down", F.sum(delta).over(w)).filter(F.col("down") > nodes - (nodes // 2 + 1)).select("run", "idx", "down")


def contiguity(log: DataFrame, by: str, idx: str) -> DataFrame:
    """Logs of ``by`` whose indexes are not one gapless run."""
    return log.groupBy(by).agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count_distinct(idx).alias("entries")).filter("last - first + 1 <> entries")


def non_vacuous(counters: DataFrame) -> DataFrame:
    """Counters ``(name, value)`` that stayed at 0: a check that saw nothing proves nothing."""
    return counters.filter("value <= 0").select("name")


def verdict(*violations: DataFrame) -> DataFrame:
    """One row: how many violations all audits found, and whether the run passed."""
    counts = [v.agg(F.count("*").alias("n")) for v in violations]
    all_ = counts[0]
    for c in counts[1:]:
        all_ = all_.unionByName(c)
    return all_.agg(F.sum("n").alias("violations")).withColumn("passed", F.col("violations") == 0)


def fault_schedule(spark, runs: int, length: int, nodes: int, seed: int) -> DataFrame:
    """Seeded fault events that never take a majority down: what would is turned into a heal of the same node."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        for pdf in batches:
            rows = []
            for run in pdf["id"]:
                rng, down = random.Random(seed * 1_000_003 + int(run)), {}
                for k in range(length):
                    node = rng.randrange(nodes)
                    if node in down:
                        kind = {"crash": "restart", "partition": "heal"}[down.pop(node)]
                    elif len(down) + 1 > nodes - (nodes // 2 + 1):
                        node = rng.choice(sorted(down))
                        kind = {"crash": "restart", "partition": "heal"}[down.pop(node)]
                    else:
                        kind = down[node] = rng.choice(("crash", "partition"))
                    rows.append((int(run), k, kind, node))
            yield pd.DataFrame(rows, columns=["run", "idx", "kind", "node"])

    ship(spark)
    return spark.range(runs).mapInPandas(make, "run long, idx long, kind string, node long")
