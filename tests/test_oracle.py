"""Every query of the catalogue against its SQL, over the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from opledger.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that SQL does not express, with the tests in ``test_operators`` that hold them against brute force.
CHECKED_ELSEWHERE = {
    "job_lifecycle": "test_job_commands_equal_a_plain_simulation", "job_final_states": "test_job_commands_equal_a_plain_simulation", "kv_linearizable": "test_linearizability_equals_all_orders",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_integer_ratio") and not isinstance(v, bool):
        return int(v) if v == int(v) else float(v)
    return v


def rows(columns, found):
    return sorted(repr([value(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    got = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        import test_operators

        assert hasattr(test_operators, CHECKED_ELSEWHERE.get(name, "")), "a query needs SQL, or a test by brute force that is named here"
        return
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())
