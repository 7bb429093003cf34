"""Entry rules as boolean Columns over the feature table. Thresholds are parameters; defaults are the frozen ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, functions as F


def _between(name: str, lo: float, hi: float) -> Column:
    return F.col(name).between(lo, hi)


def _dominates(buy: str, sell: str, pressure: float, floor: float) -> Column:
    """Buy volume is at least ``pressure`` times sell volume, where sell volume counts as ``floor`` at least."""
    return F.col(buy) >= F.lit(pressure) * F.greatest(F.col(sell), F.lit(floor))


@dataclass(frozen=True)
class Limits:
    """Bounds shared by all rules; scaled copies serve coarser bars."""

    age_low: float = 8
    age_high: float = 240
    curve_low: float = 5
    curve_high: float = 82
    max_return_5s: float = 1.25


def common_gate(lim: Limits = Limits()) -> Column:
    return (_between("age_seconds", lim.age_low, lim.age_high) & _between("curve_close", lim.curve_low, lim.curve_high)
            & (F.col("mc_close") > 0) & (F.col("return_5s") <= lim.max_return_5s))


@dataclass(frozen=True)
class Family:
    """A rule with some thresholds left open: ``fixed`` always applies, each dimension is one open threshold.

    A dimension maps a threshold to its test; ``grid`` lists the values to try. Along one dimension the tests are
    nested (a bar passing a tight value passes every looser one), so a bar's result for the whole grid is one
    small level number per dimension.
    """

    name: str
    fixed: Column
    dims: dict[str, tuple[Callable[[float], Column], bool]]  # test, and whether larger values are tighter

    def rule(self, **params: float) -> Column:
        out = self.fixed
        for dim, value in params.items():
            out = out & self.dims[dim][0](value)
        return out

    def levels(self, grid: dict[str, tuple]) -> list[tuple[str, list, Column]]:
        """(dimension, values from loose to tight, how many of them the bar passes)."""
        out = []
        for dim, values in grid.items():
            test, larger_is_tighter = self.dims[dim]
            ordered = sorted(values, reverse=not larger_is_tighter)
            level = F.lit(0)
            for v in ordered:
                level = level + F.when(test(v), 1).otherwise(0)
            out.append((dim, ordered, level))
        return out


def _at_least(name: str) -> tuple:
    return (lambda v: F.col(name) >= v), True


def _at_most(name: str) -> tuple:
    return (lambda v: F.col(name) <= v), False


def _pressure(buy: str, sell: str, floor: float) -> tuple:
    return (lambda v: _dominates(buy, sell, v, floor)), True


def families() -> dict[str, Family]:
    c = F.col
    return {
        "crowd": Family("crowd_acceleration", c("buys_5s") > c("prior_buys_5_to_15s") * 0.5, {
            "buys_2s": _at_least("buys_2s"), "buyers_5s": _at_least("buyer_seconds_5s"),
            "buy_sol_5s": _at_least("buy_sol_5s"), "pressure": _pressure("buy_sol_5s", "sell_sol_5s", 0.03)}),
        "quiet": Family("quiet_to_burst", _dominates("buy_sol_2s", "sell_sol_2s", 2.0, 0.02), {
            "buys_2s": _at_least("buys_2s"), "prior_buys_max": _at_most("prior_buys_5_to_15s"),
            "buy_sol_2s": _at_least("buy_sol_2s")}),
        "reclaim": Family("pullback_reclaim", c("drawdown_from_60s_peak") >= -0.65, {
            "drawdown": _at_most("drawdown_from_60s_peak"), "bounce": _at_least("bounce_from_15s_low"),
            "buys_2s": _at_least("buys_2s"), "pressure": _pressure("buy_sol_2s", "sell_sol_2s", 0.02)}),
        "absorb": Family("sell_absorption", (c("buy_sol_2s") >= 0.15) & (c("one_bar_return") >= -0.08)
                         & (c("drawdown_from_60s_peak") >= -0.40), {
            "sell_sol_5s": _at_least("sell_sol_5s"), "buys_2s": _at_least("buys_2s")}),
        "breadth": Family("breadth_breakout", _dominates("buy_sol_2s", "sell_sol_2s", 1.5, 0.02), {
            "current_buyers": _at_least("buyers"), "return_5s": _at_least("return_5s"), "buy_sol_2s": _at_least("buy_sol_2s")}),
        "manual": Family("manual_state_anticipation", _between("return_5s", 0.02, 0.60) & (c("drawdown_from_60s_peak") >= -0.20), {
            "age_max": _at_most("age_seconds"), "curve_min": _at_least("curve_close"), "buys_2s": _at_least("buys_2s"),
            "buy_sol_5s": _at_least("buy_sol_5s"), "pressure": _pressure("buy_sol_5s", "sell_sol_5s", 0.10)}),
    }


# The thresholds swept per family (132 configurations).
GRIDS: dict[str, dict[str, tuple]] = {
    "crowd": {"buys_2s": (3, 5, 8), "buyers_5s": (6, 10), "buy_sol_5s": (0.25, 0.75), "pressure": (1.5, 3.0)},
    "quiet": {"buys_2s": (3, 5, 8), "prior_buys_max": (1, 3, 6), "buy_sol_2s": (0.15, 0.50)},
    "reclaim": {"drawdown": (-0.15, -0.25, -0.35), "bounce": (0.08, 0.15), "buys_2s": (3, 5), "pressure": (1.5, 3.0)},
    "absorb": {"sell_sol_5s": (0.25, 0.75), "buys_2s": (3, 5, 8)},
    "breadth": {"current_buyers": (2, 4, 6), "return_5s": (0.05, 0.15), "buy_sol_2s": (0.15, 0.50)},
    "manual": {"age_max": (45, 120), "curve_min": (40, 55), "buys_2s": (5, 10), "buy_sol_5s": (3.0, 7.0, 12.0),
               "pressure": (1.2, 2.5)},
}


@dataclass(frozen=True)
class RuleConfig:
    config: str
    family: str
    params: dict


def rule_configs(grids: dict[str, dict[str, tuple]] = GRIDS) -> list[RuleConfig]:
    """Every configuration of the grids, named family-number in product order."""
    fams = families()
    return [RuleConfig(f"{short}-{i:03d}", fams[short].name, dict(zip(grid, values)))
            for short, grid in grids.items() for i, values in enumerate(product(*grid.values()))]


def finalist_gate(params: dict, lim: Limits = Limits()) -> Column:
    """The state-anticipation rule as the exit sweep applies it: no market-cap or return cap beyond its own."""
    return (families()["manual"].rule(**params) & (F.col("age_seconds") >= lim.age_low)
            & (F.col("curve_close") <= lim.curve_high))


@dataclass(frozen=True)
class BaseGate:
    """Candidate gate of the entry models."""

    age_low: float = 8
    age_high: float = 180
    curve_low: float = 35
    curve_high: float = 82
    min_buys_2s: int = 3
    min_buy_sol_5s: float = 1.0
    return_low: float = -0.20
    return_high: float = 0.80

    def scaled(self, **changes) -> "BaseGate":
        return replace(self, **changes)

    def live(self) -> Column:
        """Without ownership columns, for event streams."""
        return (_between("age_seconds", self.age_low, self.age_high) & _between("curve_close", self.curve_low, self.curve_high)
                & (F.col("buys_2s") >= self.min_buys_2s) & (F.col("buy_sol_5s") >= self.min_buy_sol_5s)
                & _between("return_5s", self.return_low, self.return_high))

    def batch(self) -> Column:
        return (self.live() & F.col("initial_top10_pct_corrected").isNotNull() & F.col("dev_buy_pct_corrected").isNotNull())


@dataclass(frozen=True)
class DumpGuard:
    enabled: bool = True
    window_ms: int = 1_000
    max_peak_drawdown_pct: float = 20
    min_sell_pressure_sol: float = 0.5
    max_sell_to_buy_ratio: float = 2

    def reasons(self, drawdown_pct: Column, buy_sol: Column, sell_sol: Column) -> Column:
        """Array of reason codes; empty when the guard stays quiet."""
        falling = (F.coalesce(drawdown_pct, F.lit(0.0)) >= self.max_peak_drawdown_pct) & (sell_sol > buy_sol)
        heavy = (sell_sol >= self.min_sell_pressure_sol) & (
            (buy_sol == 0) | (sell_sol / F.nullif(buy_sol, F.lit(0.0)) >= self.max_sell_to_buy_ratio))
        on = F.lit(self.enabled)
        return reason_list([(on & falling, "active_dump_drawdown"), (on & F.coalesce(heavy, F.lit(False)), "active_dump_pressure")])


def reason_list(checks: list[tuple[Column, str]]) -> Column:
    """Names of the checks that hold, in the given order."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]), lambda x: x.isNotNull())
