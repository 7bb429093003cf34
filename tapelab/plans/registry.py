"""Query registry: name -> Spark plan, with the equivalent SQL over the same tables where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def epoch_us(c: str) -> Column:
    return F.unix_micros(c)
