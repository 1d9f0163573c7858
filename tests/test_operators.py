"""Literal vectors and properties of the operators."""

import random
import struct
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opledger.functions.hashing import crc32c, fnv32, fnv64_hex, shard_of
from opledger.operators import asof, audit, consensus, jobs, kv, placement, ratelimit, serving, shards, textsim
from opledger.operators import reports as rp
from opledger.sources import codecs, wal

LOG = "idx long, key string, client_id string, request_id long, op string, value string, expected string, expect_absent boolean"


def test_hash_vectors(spark):
    got = spark.createDataFrame([("a",), ("foobar",), ("",)], "s string").select(fnv32(F.col("s")), fnv64_hex(F.col("s")), shard_of(F.col("s"))).collect()
    assert [r[0] for r in got] == [3826002220, 3214735720, 2166136261]
    assert [r[1] for r in got[:2]] == ["af63dc4c8601ec8c", "85944171f73967e8"]
    assert got[0][2] == 3826002220 % 10
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0


def test_cas_sequence(spark):
    steps = [("A", None, True), ("B", None, True), ("B", "Z", False), ("B", "A", False)]
    log = spark.createDataFrame([(k, "lock", "c", k + 1, "CAS", v, e, a) for k, (v, e, a) in enumerate(steps)], LOG)
    got = {r.idx: (r.swapped, r.current) for r in kv.cas_outcomes(log).collect()}
    assert got == {0: (True, None), 1: (False, "A"), 2: (False, "A"), 3: (True, "A")}
    assert {r.idx: (r.swapped, r.current) for r in kv.cas_outcomes_by_hof(log).collect()} == got
    assert [tuple(r) for r in kv.cas_state(log).collect()] == [("lock", "B")]


def test_retry_returns_the_original_result(spark):
    rows = [(0, "k", "a", 1, "PUT", "1", None, False), (1, "k", "b", 1, "GET", None, None, False), (2, "k", "a", 2, "PUT", "2", None, False), (3, "k", "b", 1, "GET", None, None, False), (4, "k", "a", 1, "PUT", "9", None, False)]
    got = {r.idx: (r["class"], r.result) for r in kv.results(spark.createDataFrame(rows, LOG)).collect()}
    assert got[3] == ("duplicate", "value=1") and got[4] == ("stale", None)


def test_no_client_is_never_deduplicated(spark):
    rows = [(k, "k", c, 1, "PUT", str(k), None, False) for k, c in enumerate(["", "", None, None])]
    assert {r["class"] for r in kv.classify(spark.createDataFrame(rows, LOG)).collect()} == {"applied"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_fold_equals_simulation(spark, seed):
    rng, rows, data, last, want = random.Random(seed), [], {}, {}, {}
    for k in range(120):
        c, r, key, op, v, e, absent = f"c{rng.randrange(4)}", rng.randrange(40), f"k{rng.randrange(3)}", rng.choice(["PUT", "GET", "DELETE", "CAS"]), f"v{rng.randrange(3)}", f"v{rng.randrange(3)}", rng.random() < 0.3
        rows.append((k, key, c, r, op, v, e, absent))
        if c in last and r <= last[c]:
            continue
        last[c] = r
        cur = data.get(key)
        if op == "PUT":
            data[key] = v
        elif op == "DELETE":
            data.pop(key, None)
        elif op == "CAS":
            swap = cur is None if absent else cur == e
            want[k] = (swap, cur)
            if swap:
                data[key] = v
    log = kv.applied(spark.createDataFrame(rows, LOG))
    assert {r.idx: (r.swapped, r.current) for r in kv.cas_outcomes(log).collect()} == want
    assert {r.key: r.value for r in kv.cas_state(log).collect()} == data


def test_rebalance_vectors():
    assert shards.rebalanced([0] * 10, [1, 2, 3]) == [1, 2, 3, 1, 2, 3, 1, 2, 3, 1]
    assert shards.rebalanced([1, 2, 3, 1, 2, 3, 1, 2, 3, 1], [1, 2, 3, 4]) == [4, 2, 4, 1, 2, 3, 1, 2, 3, 1]
    assert shards.rebalanced([1] * 10, []) == [0] * 10


@given(st.lists(st.integers(0, 12), min_size=10, max_size=10), st.sets(st.integers(1, 12), min_size=1, max_size=12))
def test_rebalance_is_even_and_moves_least(before, gids):
    after = shards.rebalanced(before, sorted(gids))
    n = Counter(after)
    assert max(n[g] for g in gids) - min(n[g] for g in gids) <= 1 and set(after) <= gids
    held = Counter(g for g in before if g in gids)
    quota = {g: 10 // len(gids) + (k < 10 % len(gids)) for k, g in enumerate(sorted(gids))}
    assert sum(a != b for a, b in zip(before, after, strict=True)) == 10 - sum(min(held[g], quota[g]) for g in gids)


def _admit(spark, rows, rate, burst):
    limits = spark.createDataFrame([("t", rate, burst)], "tenant string, rate double, burst double")
    return ratelimit.admit(spark.createDataFrame(rows, "idx long, tenant string, ts_ms long, n double"), limits).orderBy("idx").collect()


def test_token_bucket(spark):
    got = _admit(spark, [(k, "t", 0, 1.0) for k in range(10)] + [(10 + k, "t", 300, 1.0) for k in range(4)], 10.0, 5.0)
    assert [r.admitted for r in got] == [True] * 5 + [False] * 5 + [True] * 3 + [False]
    assert got[5].retry_after_ms == 100
    assert not _admit(spark, [(0, "t", 0, 6.0)], 10.0, 5.0)[0].admitted


def test_leases_never_exceed_the_bucket(spark):
    rows = spark.createDataFrame([(k, "t", k * 10, 1.0, k % 2) for k in range(60)], "idx long, tenant string, ts_ms long, n double, gateway long")
    limits = spark.createDataFrame([("t", 1.0, 10.0)], "tenant string, rate double, burst double")
    n = ratelimit.admit_leased(rows, limits, fraction=0.4).filter("admitted").count()
    assert 6 <= n <= 10


def test_placement_balance_and_disruption(spark):
    prompts = spark.range(2000).select(F.format_string("system prompt number %d: you are a helpful assistant", "id").alias("prompt"))
    fleet = spark.createDataFrame([(f"w{k}", k) for k in range(5)], "id string, inflight long")
    ranks = placement.ranked(prompts, fleet)
    four = placement.ranked(prompts, fleet.filter("id <> 'w4'"))
    counts = [r["count"] for r in placement.pick(four, 0).groupBy("worker").count().collect()]
    assert len(counts) == 4 and min(counts) >= 400 and max(counts) <= 600
    d = placement.disruption(placement.pick(ranks, 0), placement.pick(four, 0), "w4").first()
    assert d.moved_elsewhere == 0 and 0.15 <= d.moved / d.prefixes <= 0.25


def test_edit_distance(spark):
    pairs = [("", "", 0, True), ("abc", "abc", 0, True), ("kitten", "sitting", 3, True), ("kitten", "sitting", 2, False), ("summarize", "summarise", 1, True), ("abc", "", 3, True), ("abcd", "", 3, False), ("flaw", "lawn", 2, True), ("é", "e", 1, False), ("é", "e", 2, True)]
    for a, b, k, want in pairs:
        for x, y in ((a, b), (b, a)):
            assert spark.createDataFrame([(x, y)], "a string, b string").select(textsim.within_edits(F.col("a"), F.col("b"), k)).first()[0] is want


def test_near_pairs_equal_brute_force(spark):
    rng, texts = random.Random(3), []
    for k in range(25):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 40))) + "x"
        texts.append(base)
        for _ in range(2):
            t = list(base)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
            texts.append("".join(t) + "y" * (k % 2))
    norm = {}
    for k, t in enumerate(texts):
        norm.setdefault(" ".join(t.lower().split()), k)
    items = [(k, n) for n, k in norm.items() if n]
    want = {tuple(sorted((i, j))) for i, a in items for j, b in items if i < j and textsim._levenshtein(a.encode(), b.encode()) <= 3}
    got = {tuple(sorted(r)) for r in textsim.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert got == want and want


def test_near_pairs_query_equals_brute_force_beyond_ascii(spark, tmp_path):
    from opledger.plans import textsim as plans

    base = ["Große Straße über den Fluß", "déjà  vu à l'école", "plain words of ascii", "año nuevo,\u00a0niño pequeño", "日本語の文章です"]
    texts = base + ["große strasse über den fluß", "deja vu à l'ecole", "déjà vu À L'ÉCOLE", "plain wörds of ascii", "ano nuevo, niño pequeñ", "日本語の文章だ", "日本語の文書です", ""]
    rows = [(k // 4, k % 4, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    forms = {}
    for v in (0, 1):
        for c, t, text in rows:
            form, i = " ".join(text[2 * v :].split()).lower(), 2 * (c * 1000 + t) + v
            forms[form] = min(forms.get(form, i), i)
    items = [(i, f.encode()) for f, i in forms.items() if f]
    want = {(i, j) for i, a in items for j, b in items if i < j and textsim._levenshtein(a, b) <= 3}
    got = [tuple(r) for r in plans.near_duplicate_pairs(spark, str(tmp_path)).collect()]
    assert len(want) >= 4 and sorted(got) == sorted(want)


def test_nearest_ties_go_to_the_least_id(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.query_id: r.neighbour_id for r in textsim.nearest(rows, rows).collect()}
    assert got[2] == 1 and got[1] == 2 and got[3] == 1


def test_percentile_rule(spark):
    rows = spark.createDataFrame([(v,) for v in range(1, 11)], "v long")
    assert tuple(rp.percentiles(rows, "v", (50, 95, 99)).first()) == (6, 10, 10)
    assert tuple(rp.percentiles(rows.filter("v < 0"), "v", (50,)).first()) == (0,)


def test_job_fencing(spark):
    ops = [("submit", "", 0), ("claim", "a", 0), ("reap", "", 2000), ("claim", "b", 2000), ("complete", "a", 2100), ("heartbeat", "b", 2100), ("complete", "b", 2200), ("complete", "b", 2300), ("heartbeat", "b", 2400)]
    rows = spark.createDataFrame([(k, "q", op, now, None, w, 1000) for k, (op, w, now) in enumerate(ops)], "idx long, prefix string, op string, now_ms long, idem_key string, worker string, lease_ms long")
    got = [r.verdict for r in jobs.lifecycle(rows).orderBy("idx").collect()]
    assert got == ["ok", "ok", "reclaimed 1", "ok", "Fenced", "ok", "ok", "ok", "Terminal"]
    assert [tuple(r) for r in jobs.final_states(rows).collect()] == [("q", 1, "DONE", 3, 2)]


def test_audits_catch_mutations(spark):
    kind = "key string, op string, value string, expected string, found boolean, swapped boolean, failed boolean, out_value string, current string, call_ns long, return_ns long"
    good = [("x", "put", "1", None, False, False, False, None, None, 0, 10), ("x", "get", None, None, True, False, False, "1", None, 5, 20), ("x", "get", None, None, True, False, False, "1", None, 30, 40)]
    bad = [*good[:2], (*good[2][:4], False, False, False, None, None, 30, 40)]
    lost = [(*good[0][:6], True, *good[0][7:]), *bad[2:]]
    verdict = lambda rows: audit.linearizability(spark.createDataFrame(rows, kind)).first().verdict
    assert (verdict(good), verdict(bad), verdict(lost)) == ("ok", "violation", "ok")
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "log string, n long")
    assert [r.log for r in audit.contiguity(log, "log", "n").collect()] == ["b"]


def test_breaker_states_by_call_sequences():
    def after(*calls):
        state, passed = serving.Closed(), []
        for now, answer in calls:
            state, ok = serving.breaker_step(state, now, answer, 2, 100)
            passed.append(ok)
        return state, passed

    assert after((0, "failure"), (1, "success"), (2, "failure")) == (serving.Closed(1), [True] * 3)
    assert after((0, "failure"), (1, "neither"), (2, "failure")) == (serving.Open(102), [True] * 3)
    opened = ((0, "failure"), (1, "failure"))
    assert after(*opened, (50, "success")) == (serving.Open(101), [True, True, False])
    assert after(*opened, (101, "neither"), (150, "success")) == (serving.HalfOpen(101), [True, True, True, False])
    assert after(*opened, (101, "neither"), (201, "success")) == (serving.Closed(), [True] * 4)
    assert after(*opened, (101, "failure")) == (serving.Open(201), [True] * 3)


def test_leases_take_whole_tokens_of_fractional_requests(spark):
    rows = spark.createDataFrame([(1, "t", 0, 6.1, 0), (2, "t", 0, 1.5, 0), (3, "t", 0, 1.5, 0), (4, "t", 0, 0.4, 1)], "idx long, tenant string, ts_ms long, n double, gateway long")
    limits = spark.createDataFrame([("t", 1.0, 10.0)], "tenant string, rate double, burst double")
    got = ratelimit.admit_leased(rows, limits, fraction=0.9).orderBy("idx").collect()
    # 10 tokens: the first takes a lease of 9, 2.9 of it to spare; then 1.0 is left in the bucket
    assert [(r.admitted, r.from_lease) for r in got] == [(True, False), (True, True), (False, False), (True, False)]


def test_answers_to_appended_entries(spark):
    log = [(p, i, t) for p, terms in ((1, [1, 1, 2]), (2, [1]), (3, []), (4, [1, 2, 2])) for i, t in enumerate(terms, 1)]
    asked = [(1, 3, 2, 2, 9), (1, 0, 0, 1, 9), (2, 3, 2, 1, 9), (3, 0, 0, 2, 1), (4, 3, 3, 1, 2)]
    got = consensus.append_answers(spark.createDataFrame(log, "pair long, index long, term long"), spark.createDataFrame(asked, "pair long, prev_index long, prev_term long, entries long, leader_commit long"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, True, None, None, 5), (1, True, None, None, 1), (2, False, None, 2, 0), (3, True, None, None, 1), (4, False, 2, 2, 0)], key=str)
    mine, theirs = (spark.createDataFrame(x, "pair long, index long, term long") for x in ([(1, 1, 1), (1, 2, 1), (2, 1, 1)], [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 1)]))
    assert sorted(map(tuple, consensus.log_conflict(mine, theirs).collect())) == [(1, 2), (2, 2)]


def test_as_of_join_keeps_clashing_names(spark):
    rows, line = spark.createDataFrame([(1, 5, "x", "y")], "k long, at long, side string, _side string"), spark.createDataFrame([(1, 4, 7)], "k long, at long, v long")
    assert tuple(asof.asof_join(rows, line, by=["k"], at="at", values=["v"]).first()) == (1, 5, "x", "y", 7)


def test_breaker_probe(spark):
    calls = [(0, "failure"), (1, "failure"), (2, "success"), (2100, "failure"), (2200, "success"), (4200, "success"), (4300, "failure")]
    rows = spark.createDataFrame([("g", k, t, o) for k, (t, o) in enumerate(calls)], "gateway string, idx long, ts_ms long, outcome string")
    got = [(r.allowed, r.open) for r in serving.breaker(rows, threshold=2).orderBy("idx").collect()]
    assert got == [(True, False), (True, True), (False, True), (True, True), (False, True), (True, False), (True, False)]


def test_wal_statuses():
    data = wal.encoded([b"one", b"two"])
    assert [r[4] for r in wal.records(data)] == ["ok", "ok"]
    assert [r[4] for r in wal.records(data + b"\0" * 40)] == ["ok", "ok"]
    for cut in range(1, len(data)):
        assert {r[4] for r in wal.records(data[:cut])} <= {"ok", "torn"}
    broken = bytearray(data)
    broken[8] ^= 1
    assert [r[4] for r in wal.records(bytes(broken))] == ["corrupt"]
    with pytest.raises(ValueError):
        wal.encoded([b""])


def test_wal_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"payload {k}".encode()) for k in range(50)], "idx long, payload binary").repartition(3)
    wal.write_wal(rows, str(tmp_path / "log"))
    back = wal.read_wal(spark, str(tmp_path / "log"))
    assert sorted(bytes(r.payload) for r in wal.replay(back).collect()) == sorted(f"payload {k}".encode() for k in range(50))
    assert all(r.corrupt == 0 for r in wal.valid_end(back).collect())


def test_codecs(spark):
    values = spark.createDataFrame([(struct.pack(">Q", 7), b"w|1|99", b"id|12", struct.pack(">dq", 2.5, 9), struct.pack(">QI", 5, 2) + b"hi there"), (b"x", b"", b"pending|8", b"x", b"x")], "c binary, l binary, i binary, b binary, e binary")
    rows = values.select(codecs.counter(F.col("c")).cast("long").alias("c"), codecs.leader(F.col("l")).alias("l"), codecs.idempotency(F.col("i")).alias("i"), codecs.bucket("b").alias("b"), codecs.entry("e").alias("e")).collect()
    assert [r.c for r in rows] == [7, 0] and tuple(rows[0].l) == ("w|1", 99)
    assert rows[0].i.job_id == 12 and rows[1].i.pending_until_ms == 8
    assert tuple(rows[0].b) == (2.5, 9) and rows[1].b.tokens is None
    assert tuple(rows[0].e) == (5, "hi", " there") and rows[1].e.prompt is None


def test_snapshot_version(spark):
    state = spark.createDataFrame([("k", "v")], "key string, value string")
    assert wal.restored(wal.with_snapshot_version(state)).count() == 1
    with pytest.raises(Exception, match="version"):
        wal.restored(wal.with_snapshot_version(state, 2)).collect()


def _simulated(commands, max_queue, max_attempts=3):
    """Job commands by the plain rules, over lists searched from the front."""
    rows, records, keys, held = [], [], {}, {}
    done = 0
    for idx, op, now, key, worker in commands:
        job, verdict = None, ""
        head = next((r["id"] for r in records if r["state"] in ("PENDING", "RUNNING")), len(records) + 1)
        if op == "submit":
            finished = max(done, head - 1)
            if key in keys:
                job, verdict = keys[key], "duplicate"
            elif len(records) - finished >= max_queue or len(records) >= head and len(records) - head + 1 >= 16 * max_queue:
                verdict = "QueueFull"
            else:
                job = keys[key] = len(records) + 1
                records.append({"id": job, "state": "PENDING", "gen": 0, "attempts": 0, "worker": "", "lease": 0})
                verdict = "ok"
        elif op == "claim":
            verdict = "empty"
            for r in records:
                late = r["state"] == "RUNNING" and r["lease"] < now
                if late and r["attempts"] >= max_attempts:
                    r.update(state="FAILED", gen=r["gen"] + 1)
                    done += 1
                elif late or r["state"] == "PENDING":
                    r.update(state="RUNNING", gen=r["gen"] + 1, attempts=r["attempts"] + 1, worker=worker, lease=now + 100)
                    held[worker], job, verdict = (r["id"], r["gen"]), r["id"], "ok"
                    break
        elif op == "reap":
            late = [r for r in records if r["state"] == "RUNNING" and r["lease"] < now]
            for r in late:
                r.update(state="FAILED" if r["attempts"] >= max_attempts else "PENDING", gen=r["gen"] + 1, worker="")
            verdict = f"reclaimed {len(late)}"
        elif worker not in held:
            verdict = "idle"
        else:
            job, gen = held[worker]
            r = records[job - 1]
            mine = r["state"] == "RUNNING" and r["gen"] == gen
            if r["state"] == "FAILED" or r["state"] == "DONE" and (op == "heartbeat" or op == "fail" and r["gen"] == gen):
                verdict = "Terminal"
            elif r["state"] == "DONE":
                verdict = "ok" if r["gen"] == gen else "Fenced"
            elif not mine:
                verdict = "Fenced"
            else:
                verdict = "ok"
                if op == "heartbeat":
                    r["lease"] = now + 100
                elif op == "complete":
                    r["state"] = "DONE"
                    done += 1
                else:
                    failed = r["attempts"] >= max_attempts
                    r.update(gen=r["gen"] + 1, worker="", state="FAILED" if failed else "PENDING")
                    done += failed
        r = records[job - 1] if job else {}
        rows.append((idx, op, job, r.get("state"), r.get("gen"), r.get("attempts"), r.get("worker"), verdict))
    return rows, sorted((r["id"], r["state"], r["gen"], r["attempts"]) for r in records)


def test_job_commands_equal_a_plain_simulation(spark):
    rng, all_rows, want, finals = random.Random(11), [], [], []
    for q in range(6):
        now, mine = 0, []
        for k in range(300):
            now += rng.randrange(30)
            mine.append((1000 * q + k, rng.choice(["submit", "submit", "claim", "claim", "heartbeat", "complete", "fail", "reap"]), now, f"o{rng.randrange(80)}", f"w{rng.randrange(5)}"))
        rows, final = _simulated(mine, 8)
        want += [(r[0], f"q{q}", *r[1:]) for r in rows]
        finals += [(f"q{q}", *f) for f in final]
        all_rows += [(idx, f"q{q}", op, now_ms, key, worker, 100) for idx, op, now_ms, key, worker in mine]
    commands = spark.createDataFrame(all_rows, "idx long, prefix string, op string, now_ms long, idem_key string, worker string, lease_ms long")
    got = [tuple(r[c] for c in ("idx", "prefix", "op", "id", "state", "gen", "attempts", "worker", "verdict")) for r in jobs.lifecycle(commands, max_queue=8).collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g == w
    assert sorted(map(tuple, jobs.final_states(commands, max_queue=8).collect())) == sorted(finals)


def test_linearizability_equals_all_orders(spark):
    """Small histories against every order that respects the intervals."""
    from itertools import permutations

    rng, rows, want = random.Random(5), [], {}
    for key in range(60):
        ops, value, t = [], None, 0
        for _ in range(5):
            kind = rng.choice(["get", "put", "cas"])
            begin = t + rng.randrange(3)
            end = begin + rng.randrange(1, 8)
            t = begin
            seen = rng.choice([value, value, rng.choice([None, "a", "b"])])
            new, expected, failed = rng.choice("ab"), rng.choice([None, "a", "b"]), rng.random() < 0.15
            fits = seen == expected
            ops.append({"op": kind, "value": new, "expected": expected, "found": seen is not None, "swapped": fits, "failed": failed, "out_value": seen, "current": seen, "call_ns": begin, "return_ns": end})
            if kind == "put" or kind == "cas" and fits:
                value = new

        def legal(order):
            states = {None}
            for k, o in enumerate(order):
                if any(later["return_ns"] < o["call_ns"] for later in order[k + 1 :]):
                    return False
                states = {s for v in states for s in audit.model_step(v, o) or ()}
                if not states:
                    return False
            return True

        want[f"k{key}"] = "ok" if any(legal(p) for p in permutations(ops)) else "violation"
        rows += [(f"k{key}", *(o[c] for c in ("op", "value", "expected", "found", "swapped", "failed", "out_value", "current", "call_ns", "return_ns"))) for o in ops]
    history = spark.createDataFrame(rows, "key string, op string, value string, expected string, found boolean, swapped boolean, failed boolean, out_value string, current string, call_ns long, return_ns long")
    got = {r.key: r.verdict for r in audit.linearizability(history).collect()}
    assert got == want and set(want.values()) == {"ok", "violation"}


def test_persister_files_round_trip(spark, tmp_path):
    whole = wal.persister_file(b"state", b"snap")
    assert wal.persisted(whole) == (b"state", b"snap") and wal.persisted(wal.persister_file(b"s", None)) == (b"s", None)
    assert wal.persisted(whole[:-1]) is None and wal.persisted(b"XXXX" + whole[4:]) is None and wal.persisted(whole[:13] + b"!" + whole[14:]) is None
    (tmp_path / "a").write_bytes(whole)
    (tmp_path / "b").write_bytes(whole[:-2])
    got = {r.file.rsplit("/", 1)[1]: (r.state, r.snapshot, r.corrupt) for r in wal.read_persisted(spark, str(tmp_path)).collect()}
    assert {k: (bytes(v[0]), bytes(v[1])) if v[0] is not None else v[2] for k, v in got.items()} == {"a": (b"state", b"snap"), "b": True}
