"""Chronological splits, trade metrics, drawdown, finalist selection, promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapelab.functions.exprs import count_if
from tapelab.operators.scan import max_drawdown

DAY_US = 86_400_000_000
SPLITS = ("train", "validation", "test")


def split_col(t_us: Column, start_us: Column, train_days: int = 4, validation_days: int = 1,
              total_days: int | None = None) -> Column:
    """train / validation / test by entry time; with ``total_days``, later trades belong to no split."""
    d = t_us - start_us
    rest = F.lit("test") if total_days is None else F.when(d <= total_days * DAY_US, F.lit("test"))
    return (F.when(d < train_days * DAY_US, "train")
            .when(d < (train_days + validation_days) * DAY_US, "validation").otherwise(rest))


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: counts, PnL, win rate, largest profit share and drawdown of realised equity in exit order.

    ``trades`` needs mint, exit_us, pnl_sol, exit_reason. Drawdown is combined from equal cells, so a key with most
    of the trades is not one task.
    """
    pnl = F.col("pnl_sol")
    base = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum(pnl).alias("pnl"),
        count_if(pnl > 0).alias("wins"),
        F.max(pnl).alias("largest"),
        count_if(F.col("exit_reason") == "TAKE_PROFIT").alias("take_profits"),
        count_if(F.col("exit_reason") == "STOP_LOSS").alias("stop_losses"))
    dd = max_drawdown(trades, keys, [F.col("exit_us"), F.col("mint")], pnl, "max_drawdown_sol")
    return base.join(dd, keys).select(
        *keys, "trades", F.col("pnl").alias("pnl_sol"), (F.col("pnl") / F.col("trades")).alias("average_pnl_sol"),
        (F.col("wins") / F.col("trades")).alias("win_rate"),
        F.when(F.col("pnl") > 0, F.col("largest") / F.nullif(F.col("pnl"), F.lit(0.0))).alias("largest_profit_share"),
        "max_drawdown_sol", "take_profits", "stop_losses")


def by_split(metrics: DataFrame, config_keys: list[str], grid: DataFrame | None = None) -> DataFrame:
    """One row per configuration with train_/validation_/test_ columns; silent configurations show zeros.

    ``grid`` is the small table of all configurations.
    """
    cols = [c for c in metrics.columns if c not in (*config_keys, "split")]
    wide = metrics.groupBy(*config_keys).agg(*[
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in SPLITS for c in cols])
    if grid is not None:
        wide = grid.join(wide, config_keys, "left")
    zero = {f"{s}_{c}": 0 for s in SPLITS for c in ("trades", "take_profits", "stop_losses")}
    zero |= {f"{s}_{c}": 0.0 for s in SPLITS for c in ("pnl_sol", "max_drawdown_sol")}
    return wide.fillna({k: v for k, v in zero.items() if k in wide.columns})


def freeze(wide: DataFrame, min_trades: int, top: int, tie_break: list[str]) -> DataFrame:
    """The best configurations by training PnL among those with enough training trades."""
    return (wide.where(F.col("train_trades") >= min_trades)
            .orderBy(F.col("train_pnl_sol").desc(), *[F.col(c).asc() for c in tie_break]).limit(top))


def survivors(frozen: DataFrame, require_train_profit: bool = False, min_trades: int = 5, max_share: float = 0.60) -> DataFrame:
    """Frozen configurations that also hold up in validation."""
    ok = ((F.col("validation_trades") >= min_trades) & (F.col("validation_pnl_sol") > 0)
          & (F.coalesce("validation_largest_profit_share", F.lit(0.0)) <= max_share))
    return frozen.where(ok & (F.col("train_pnl_sol") > 0) if require_train_profit else ok)


def promotion_gate(trades: DataFrame, base_account: str, shadow_account: str, min_signals: int = 200,
                   max_share: float = 0.25) -> DataFrame:
    """One row of pass/fail columns for promoting a paper account. ``trades``: account, pnl_sol, invalidated."""
    a, pnl, valid = F.col("account"), F.col("pnl_sol"), ~F.col("invalidated")
    base, shadow = (a == base_account) & valid, (a == shadow_account) & valid
    agg = trades.agg(
        count_if(base).alias("signals"), F.sum(F.when(base, pnl)).alias("base_pnl_sol"),
        F.sum(F.when(shadow, pnl)).alias("shadow_pnl_sol"), F.max(F.when(base, pnl)).alias("largest"),
        count_if(F.col("invalidated")).alias("data_gaps"))
    p = F.coalesce("base_pnl_sol", F.lit(0.0))
    share = F.when(p > 0, F.col("largest") / F.nullif(p, F.lit(0.0)))
    checks = {"enough_signals": F.col("signals") >= min_signals, "base_positive": p > 0,
              "shadow_positive": F.coalesce("shadow_pnl_sol", F.lit(0.0)) > 0,
              "not_concentrated": F.coalesce(share <= max_share, F.lit(False)), "no_data_gaps": F.col("data_gaps") == 0}
    every = None
    for c in checks.values():
        every = c if every is None else every & c
    return agg.select("signals", "base_pnl_sol", "shadow_pnl_sol", share.alias("largest_profit_share"), "data_gaps",
                      *[c.alias(n) for n, c in checks.items()], every.alias("promote"))
