"""Lease-based job queue: lifecycle fold, fencing, idempotency, audits.

Commands have ``idx, prefix, op`` (submit, claim, heartbeat, complete, fail, reap),
``now_ms``, ``idem_key``, ``worker`` and ``lease_ms``.  A queue is a prefix; its
commands are one order.  A worker that completes, fails or heartbeats presents the
job and generation that it claimed last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opledger.operators.folds import fold

MAX_QUEUE, SPAN_FACTOR, MAX_ATTEMPTS = 1024, 16, 3
TERMINAL = ("DONE", "FAILED")
TRANSITIONS = "idx long, prefix string, op string, id long, state string, gen long, attempts long, worker string, verdict string"


class _Queue:
    """Live jobs by id, what became of the others, bound idempotency keys, and what workers hold."""

    def __init__(self):
        self.tail, self.head, self.done = 0, 1, 0
        self.live: dict[int, dict] = {}
        self.ended: dict[int, tuple[str, int, int, str]] = {}
        self.keys: dict[str, int] = {}
        self.held: dict[str, tuple[int, int]] = {}

    def end(self, j: dict, state: str, counted: bool = True) -> None:
        j["state"], j["lease"] = state, 0
        self.ended[j["id"]] = (state, j["gen"], j["attempts"], j["worker"])
        del self.live[j["id"]]
        self.done += counted
        while self.head <= self.tail and self.head in self.ended:
            self.head += 1


def holder_verdict(state: Column, gen: Column, presented: Column) -> Column:
    """How a presented generation fares: ok, Fenced or Terminal; a repeated completion of one generation is ok."""
    return F.when(state == "FAILED", "Terminal").when(state == "DONE", F.when(gen == presented, "ok").otherwise("Fenced")).when((state == "RUNNING") & (gen == presented), "ok").otherwise("Fenced")


def _submit(q: _Queue, row: dict, max_queue: int) -> tuple:
    key = row["idem_key"]
    if key and key in q.keys:
        return q.keys[key], "duplicate"
    done = max(q.done, q.head - 1)
    if done < q.tail and q.tail - done >= max_queue or q.tail >= q.head and q.tail - q.head + 1 >= SPAN_FACTOR * max_queue:
        return None, "QueueFull"
    q.tail += 1
    q.live[q.tail] = {"id": q.tail, "state": "PENDING", "gen": 0, "worker": "", "lease": 0, "attempts": 0}
    if key:
        q.keys[key] = q.tail
    return q.tail, "ok"


def _claim(q: _Queue, row: dict, max_attempts: int) -> tuple:
    for j in list(q.live.values()):
        expired = j["state"] == "RUNNING" and j["lease"] < row["now_ms"]
        if expired and j["attempts"] >= max_attempts:
            j["gen"] += 1
            q.end(j, "FAILED")
        elif expired or j["state"] == "PENDING":
            j.update(state="RUNNING", gen=j["gen"] + 1, worker=row["worker"], attempts=j["attempts"] + 1, lease=row["now_ms"] + row["lease_ms"])
            q.held[row["worker"]] = (j["id"], j["gen"])
            return j["id"], "ok"
    return None, "empty"


def _held(q: _Queue, row: dict, max_attempts: int) -> tuple:
    if row["worker"] not in q.held:
        return None, "idle"
    job, gen = q.held[row["worker"]]
    if job in q.ended:
        state, last, _, _ = q.ended[job]
        if state == "FAILED" or row["op"] == "heartbeat":
            return job, "Terminal"
        return job, "ok" if last == gen and row["op"] == "complete" else "Terminal" if last == gen else "Fenced"
    j = q.live[job]
    if j["state"] != "RUNNING" or j["gen"] != gen:
        return job, "Fenced"
    if row["op"] == "heartbeat":
        j["lease"] = row["now_ms"] + row["lease_ms"]
    elif row["op"] == "complete":
        q.end(j, "DONE")
    else:
        j.update(gen=j["gen"] + 1, worker="", lease=0, state="PENDING")
        if j["attempts"] >= max_attempts:
            q.end(j, "FAILED")
    return job, "ok"


def _reap(q: _Queue, row: dict, max_attempts: int) -> tuple:
    expired = [j for j in q.live.values() if j["state"] == "RUNNING" and j["lease"] < row["now_ms"]]
    for j in expired:
        j.update(gen=j["gen"] + 1, worker="", lease=0, state="PENDING")
        if j["attempts"] >= max_attempts:
            q.end(j, "FAILED", counted=False)
    return None, f"reclaimed {len(expired)}"


def _stepper(max_queue: int, max_attempts: int):
    def step(q: _Queue, row: dict) -> list[tuple]:
        op = row["op"]
        if op == "submit":
            job, verdict = _submit(q, row, max_queue)
        elif op == "claim":
            job, verdict = _claim(q, row, max_attempts)
        elif op == "reap":
            job, verdict = _reap(q, row, max_attempts)
        elif op in ("heartbeat", "complete", "fail"):
            job, verdict = _held(q, row, max_attempts)
        else:
            raise ValueError(f"unknown operation {op}")
        j = q.live.get(job)
        state, gen, attempts, worker = (j["state"], j["gen"], j["attempts"], j["worker"]) if j else q.ended.get(job, (None, None, None, None))
        return [(row["idx"], row["prefix"], op, job, state, gen, attempts, worker, verdict)]

    return step


def lifecycle(commands: DataFrame, *, max_queue: int = MAX_QUEUE, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per command with its verdict and the job after it."""
    return fold(commands, ["prefix"], ["idx"], _Queue, _stepper(max_queue, max_attempts), TRANSITIONS)


def final_states(commands: DataFrame, *, max_queue: int = MAX_QUEUE, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per job of every queue after all commands."""
    step = _stepper(max_queue, max_attempts)

    def silent(q: _Queue, row: dict) -> list[tuple]:
        step(q, row)
        return []

    def finish(key: tuple, q: _Queue) -> list[tuple]:
        live = [(key[0], j["id"], j["state"], j["gen"], j["attempts"]) for j in q.live.values()]
        return live + [(key[0], i, state, gen, attempts) for i, (state, gen, attempts, _) in q.ended.items()]

    return fold(commands, ["prefix"], ["idx"], _Queue, silent, "prefix string, id long, state string, gen long, attempts long", finish)


def idempotent_ids(submits: DataFrame) -> DataFrame:
    """Id of each submit without admission limits: the first of a key makes it, later ones share it."""
    by_key = F.struct("prefix", F.coalesce("idem_key", F.concat(F.lit("\0"), F.col("idx").cast("string"))).alias("key")).alias("job")
    rows = submits.select("idx", "prefix", by_key)
    first = rows.groupBy("job").agg(F.min("idx").alias("first")).withColumn("id", F.row_number().over(Window.partitionBy("job.prefix").orderBy("first")).cast("bigint"))
    return rows.join(first, "job").select("idx", "prefix", "id", (F.col("idx") == F.col("first")).alias("created"))


def admission_audit(commands: DataFrame, max_queue: int) -> DataFrame:
    """Per queue: the most jobs that were open at once if all submits were taken, and whether the limit was passed."""
    delta = F.when(F.col("op") == "submit", 1).when(F.col("op") == "complete", -1).otherwise(0)
    open_ = F.sum(delta).over(Window.partitionBy("prefix").orderBy("idx"))
    return commands.withColumn("open", open_).groupBy("prefix").agg(F.max("open").alias("most_open")).withColumn("exceeded", F.col("most_open") > max_queue)


def expired_leases(jobs: DataFrame, now_ms: int, *, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs whose lease ended before ``now_ms`` and what reaping makes of them."""
    gone = jobs.filter((F.col("state") == "RUNNING") & (F.col("lease_until_ms") < now_ms))
    return gone.select("id", F.when(F.col("attempts") >= max_attempts, "FAILED").otherwise("PENDING").alias("becomes"), (F.col("gen") + 1).alias("gen"))


def expired_stages(jobs: DataFrame, now_ms: int, *, ttl_ms: int = 60_000) -> DataFrame:
    """Staged jobs that were never published within the time to live."""
    return jobs.filter((F.col("state") == "STAGED") & (F.lit(now_ms) - F.col("submitted_ms") > ttl_ms))


def watch(snapshots: DataFrame) -> DataFrame:
    """Snapshots of a job that differ from the one before in state, generation, worker or attempts."""
    now = F.struct("state", "gen", "worker", "attempts")
    before = F.lag(now).over(Window.partitionBy("id").orderBy("idx"))
    return snapshots.withColumn("before", before).filter(F.col("before").isNull() | ~F.col("before").eqNullSafe(now)).drop("before")


def depth(jobs: DataFrame) -> DataFrame:
    """Per queue: tail, head (first job that is not terminal, else tail + 1) and tail less head, signed."""
    open_ = F.min(F.when(~F.col("state").isin(*TERMINAL), F.col("id")))
    out = jobs.groupBy("prefix").agg(F.max("id").alias("tail"), open_.alias("open"))
    head = F.coalesce("open", F.col("tail") + 1)
    return out.select("prefix", "tail", head.alias("head"), (F.col("tail") - head).alias("depth"))


def error_code(verdict: Column) -> Column:
    return F.when(verdict == "QueueFull", "ResourceExhausted").when(verdict.isin("Fenced", "Terminal"), "FailedPrecondition").when(verdict == "NotFound", "NotFound").when(verdict.isin("ok", "duplicate", "empty", "idle"), "OK").otherwise("Unavailable")


def leader(attempts: DataFrame, ttl_ms: int) -> DataFrame:
    """Who leads after each attempt ``(idx, prefix, holder, now_ms)``: a leader renews, others wait for the lease to end."""

    def step(cell: list, row: dict) -> list[tuple]:
        if not cell or cell[0] == row["holder"] or not cell[1] > row["now_ms"]:
            cell[:] = [row["holder"], row["now_ms"] + ttl_ms]
        return [(row["idx"], row["prefix"], cell[0], cell[0] == row["holder"])]

    return fold(attempts, ["prefix"], ["idx"], list, step, "idx long, prefix string, leader string, leads boolean")


def exactly_once(completes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Violations ``(prefix, id, violation)``: accepted twice, done without acceptance, accepted but not done, other result."""
    accepted = completes.filter("accepted").groupBy("prefix", "id").agg(F.count_distinct("gen").alias("n"), F.max("result").alias("won"))
    both = accepted.join(jobs.select("prefix", "id", "state", F.col("result").alias("kept")), ["prefix", "id"], "full_outer")
    done = F.coalesce(F.col("state") == "DONE", F.lit(False))
    bad = F.when(F.col("n") > 1, "accepted twice").when(done & F.col("n").isNull(), "done without acceptance").when(F.col("n").isNotNull() & ~done, "accepted but not done").when(done & (F.col("won") != F.col("kept")), "another result")
    return both.select("prefix", "id", bad.alias("violation")).filter("violation is not null")


def idempotency(submits: DataFrame) -> DataFrame:
    """Keys of submit results ``(prefix, idem_key, id)`` that got more than one id."""
    return submits.filter("idem_key is not null").groupBy("prefix", "idem_key").agg(F.count_distinct("id").alias("ids")).filter("ids > 1")
