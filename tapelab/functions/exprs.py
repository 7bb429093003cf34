"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0 (ANSI mode would raise)."""
    return num / F.nullif(den, F.lit(0))


def ratio_minus_one(num: Column, den: Column) -> Column:
    return safe_div(num, den) - F.lit(1.0)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def floor_div(t: Column, width: int) -> Column:
    """Exact integer division of a BIGINT, flooring toward minus infinity."""
    w = F.lit(width).cast("long")
    return F.call_function("div", t - F.pmod(t, w), w)


def order_key(t_us: Column, tie: Column) -> Column:
    """(time, id) as one number. Unlike a struct it fits an aggregation buffer, so min_by/max_by stay hash aggregates."""
    return t_us.cast("decimal(19,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + tie.cast("decimal(19,0)")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value))


def max_if(cond: Column, value: Column) -> Column:
    return F.max(F.when(cond, value))


def min_if(cond: Column, value: Column) -> Column:
    return F.min(F.when(cond, value))


def value_at_min(value: Column, key: Column) -> Column:
    """Value at the smallest key among rows whose value is not NULL."""
    return F.min_by(value, F.when(value.isNotNull(), key))


def value_at_max(value: Column, key: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), key))


def literal_rows(rows: list[dict]) -> Column:
    """A fixed parameter table as one array-of-struct literal: explode it instead of joining to it."""
    def lit(v: object) -> Column:
        return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)
    return F.array(*[F.struct(*[lit(v).alias(k) for k, v in row.items()]) for row in rows])


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once. Keeps nested exact arithmetic from growing the generated code."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
