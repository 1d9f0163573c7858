"""Serving queries where larger tables decide: requests that find exactly their tokens, and folds after joins that adapt."""

import duckdb
import pytest
from pyspark.sql import functions as F

from opledger.operators.folds import fold
from opledger.plans import serving


@pytest.fixture(scope="module")
def exact(tmp_path_factory):
    """Four requests empty a bucket, one comes ten seconds after the next token, and one when another is exactly full."""
    d = tmp_path_factory.mktemp("exact")
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(ms) AS ts, 0::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{\"k\": 1}' AS props FROM (VALUES (0::BIGINT, 0), (1, 0), (2, 0), (3, 0), (4, 3610000), (5, 7200000)) v(i, ms)")
    con.execute("CREATE TABLE benchmark AS SELECT i AS item_id, 'text ' || i AS text FROM range(6) r(i)")
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey FROM range(1, 9) r(i)")
    for t in ("events", "benchmark", "supplier"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d), con


def both(spark, exact, name):
    d, con = exact
    found = con.execute(serving.ORACLE[name])
    columns = [c[0] for c in found.description]
    return sorted(tuple(r[c] for c in columns) for r in serving.QUERIES[name](spark, d).collect()), sorted(found.fetchall())


def test_pipeline_counters_at_an_exact_refill(spark, exact):
    got, want = both(spark, exact, "gw_pipeline_counters")
    assert got == want == [("routed", 6)]


def test_pipeline_outcomes_at_an_exact_refill(spark, exact):
    got, want = both(spark, exact, "gw_pipeline_outcomes")
    assert got == want and len(got) == 6


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned as sorted ones, and turn into broadcasts of their small sides while they run, as at size."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fold_keeps_a_key_in_one_task_after_a_join_by_it(spark, late_broadcast):
    rows = spark.range(0, 4000, numPartitions=4).select((F.col("id") % 3).alias("key"), "id")
    joined = rows.join(spark.range(3).withColumnRenamed("id", "key"), "key")

    def step(cell, row):
        cell[0] += 1
        return []

    got = fold(joined, ["key"], ["id"], lambda: [0], step, "key long, n long", lambda key, cell: [(key[0], cell[0])]).collect()
    assert sorted(map(tuple, got)) == [(0, 1334), (1, 1333), (2, 1333)]
