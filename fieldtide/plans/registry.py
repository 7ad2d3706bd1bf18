"""Registry of plans and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def day(c: Column | str) -> Column:
    """Date as text, empty when missing."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def r6(c: Column | str) -> Column:
    """Six decimals, halves away from zero, in binary arithmetic."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    half_up = lambda v: F.floor(v * 1e6 + 0.5) / F.lit(1e6)
    return F.when(x >= 0, half_up(x)).when(x < 0, -half_up(-x)).otherwise(x)


def bit(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


def num(c: Column | str) -> Column:
    """Whole number, -1 when missing."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("bigint"), F.lit(-1).cast("bigint"))
