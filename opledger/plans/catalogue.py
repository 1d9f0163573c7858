"""All queries over the driver's tables, with the SQL each is compared with."""

from __future__ import annotations

from importlib import import_module

BOOKS = ("kv", "shards", "ratelimit", "placement", "textsim", "jobs", "serving", "reports", "audit")


def queries() -> dict:
    return {name: f for b in BOOKS for name, f in import_module(f"opledger.plans.{b}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for b in BOOKS for name, sql in import_module(f"opledger.plans.{b}").ORACLE.items()}
