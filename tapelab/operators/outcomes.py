"""Bar replay: enter at the bar after a signal, walk later bars, exit at the first trigger.

A mint has at most max_age / width + 1 bars, so the bars after one entry are a small bounded set however many
trades the mint has. Everything below is joins on the mint and aggregates per (mint, entry).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapelab.functions.bar_amm import Costs, entry_tokens, liquidation_pnl

STOP_CURVE = 95.0

# The exit grid swept on finalists and cohorts.
TP_VALUES = (0.15, 0.25, 0.40, 0.60, 1.00)
SL_VALUES = (-0.10, -0.15, -0.25, -0.40)
HOLD_VALUES = (10, 20, 40, 80, 150)


def exit_grid(tps=TP_VALUES, sls=SL_VALUES, holds=HOLD_VALUES) -> list[dict]:
    return [{"exit_id": i, "tp": tp, "sl": sl, "hold": hold} for i, (tp, sl, hold) in enumerate(product(tps, sls, holds))]


def bar_path(bars: DataFrame) -> DataFrame:
    """Bars in the shape replay needs: position in the mint and how often the curve had closed out so far."""
    w = Window.partitionBy("mint").orderBy("bucket")
    done = F.when(F.col("curve_close") >= STOP_CURVE, 1).otherwise(0)
    return bars.select(
        "mint", F.unix_micros("bucket").alias("t"), F.row_number().over(w).alias("rn"),
        F.sum(done).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("closed_out"),
        "curve_close", "mc_close", "v_sol_close", "v_tokens_close")


def entries(signals: DataFrame, path: DataFrame, costs: Costs, signal_us: str = "signal_us") -> DataFrame:
    """The bar after each distinct (mint, signal bar), with the tokens bought there; unusable entries drop out."""
    here = path.select("mint", F.col("t").alias(signal_us), (F.col("rn") + 1).alias("rn"))
    at = signals.select("mint", signal_us).distinct().join(here, ["mint", signal_us])
    ent = path.select("mint", "rn", F.col("t").alias("entry_us"), F.col("closed_out").alias("entry_closed_out"),
                      F.col("mc_close").alias("entry_mc"), F.col("curve_close").alias("entry_curve"),
                      entry_tokens(F.col("v_sol_close"), F.col("v_tokens_close"), costs.size_sol, costs.fee_rate).alias("tokens"))
    return (at.join(ent, ["mint", "rn"]).withColumnRenamed("rn", "entry_rn")
            .where((F.col("entry_curve") < STOP_CURVE) & F.col("tokens").isNotNull()).drop("entry_curve"))


def forward_path(ents: DataFrame, path: DataFrame, costs: Costs, max_elapsed_us: int | None = None) -> DataFrame:
    """Quotable bars after each entry, up to the first closed-out bar (and ``max_elapsed_us`` when given)."""
    b = path.withColumnRenamed("t", "bar_us")
    cond_rows = ents.join(b, "mint").where((F.col("rn") > F.col("entry_rn")) & (F.col("closed_out") == F.col("entry_closed_out")))
    if max_elapsed_us is not None:
        cond_rows = cond_rows.where(F.col("bar_us") - F.col("entry_us") <= max_elapsed_us)
    pnl = liquidation_pnl(F.col("v_sol_close"), F.col("v_tokens_close"), F.col("tokens"), costs.size_sol, costs.fee_rate,
                          costs.tx_cost)
    return (cond_rows.withColumn("pnl", pnl).where(F.col("pnl").isNotNull())
            .withColumn("elapsed_us", F.col("bar_us") - F.col("entry_us"))
            .withColumn("ret", F.col("pnl") / F.lit(costs.basis)))


def _at(kind: str = "at") -> Column:
    return F.struct(F.col("rn"), F.col("bar_us"), F.col("pnl"), F.col("mc_close"), F.col("peak"), F.col("trough")).alias(kind)


def label_trades(signals: DataFrame, bars: DataFrame, tp: float, sl: float, hold_us: int, costs: Costs = Costs(),
                 signal_us: str = "signal_us") -> DataFrame:
    """One outcome per distinct (mint, signal bar): the first of take-profit, stop-loss, hold reached, or last bar.

    exit_reason is TIMEOUT unless a price trigger fired; ``ended_by`` tells a reached hold from a path that ended.
    """
    path = bar_path(bars)
    steps = forward_path(entries(signals, path, costs, signal_us), path, costs)
    upto = (Window.partitionBy("mint", signal_us).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumns({"peak": F.max("pnl").over(upto), "trough": F.min("pnl").over(upto)})
    is_tp, is_sl, is_hold = F.col("ret") >= tp, F.col("ret") <= sl, F.col("elapsed_us") >= hold_us
    fired = is_tp | is_sl | is_hold
    out = steps.groupBy("mint", signal_us).agg(
        F.min("entry_us").alias("entry_us"), F.min("entry_mc").alias("entry_mc"),
        F.min(F.when(fired, _at())).alias("hit"), F.max(_at()).alias("last"))
    x = F.coalesce("hit", "last")
    ret = x["pnl"] / F.lit(costs.basis)
    return out.select(
        "mint", signal_us, "entry_us", x["bar_us"].alias("exit_us"), x["pnl"].alias("pnl_sol"),
        (ret * 100).alias("return_pct"), x["peak"].alias("peak_pnl_sol"), x["trough"].alias("trough_pnl_sol"),
        F.when(ret >= tp, "TAKE_PROFIT").when(ret <= sl, "STOP_LOSS").otherwise("TIMEOUT").alias("exit_reason"),
        F.when(F.col("hit").isNull(), "PATH_END").otherwise("TRIGGER").alias("ended_by"),
        F.col("entry_mc").alias("entry_market_cap_sol"), x["mc_close"].alias("exit_market_cap_sol"))


def sweep_exits(signals: DataFrame, bars: DataFrame, tps=TP_VALUES, sls=SL_VALUES, holds=HOLD_VALUES,
                hold_unit_us: int = 1_000_000, max_elapsed_us: int = 180_000_000, costs: Costs = Costs(),
                signal_us: str = "signal_us", ents: DataFrame | None = None, path: DataFrame | None = None) -> DataFrame:
    """Outcomes of every exit setting for each distinct (mint, signal bar).

    The path is walked once: the first bar passing each take-profit, each stop and each hold is one conditional
    minimum (14 for the 100-point grid); an exit setting is the least of its three. Rows grow only at the end.
    """
    path = bar_path(bars) if path is None else path
    ents = entries(signals, path, costs, signal_us) if ents is None else ents
    steps = forward_path(ents, path, costs, max_elapsed_us)
    at = F.struct("rn", "bar_us", "pnl")
    agg = steps.groupBy("mint", signal_us).agg(
        F.min("entry_us").alias("entry_us"), F.max(at).alias("last"),
        *[F.min(F.when(F.col("ret") >= v, at)).alias(f"tp{i}") for i, v in enumerate(tps)],
        *[F.min(F.when(F.col("ret") <= v, at)).alias(f"sl{i}") for i, v in enumerate(sls)],
        *[F.min(F.when(F.col("elapsed_us") >= v * hold_unit_us, at)).alias(f"ho{i}") for i, v in enumerate(holds)])
    pick = lambda tag, values: F.array(*[F.col(f"{tag}{i}") for i in range(len(values))])
    # Three short explodes give the grid; positions name the setting.
    grid = (agg.select("mint", signal_us, "entry_us", "last", pick("sl", sls).alias("sls"), pick("ho", holds).alias("hos"),
                       F.posexplode(pick("tp", tps)).alias("i", "tp"))
            .select("*", F.posexplode("sls").alias("j", "sl")).drop("sls")
            .select("*", F.posexplode("hos").alias("k", "ho")).drop("hos"))
    x = F.coalesce(F.least("tp", "sl", "ho"), F.col("last"))
    reason = (F.when(F.col("tp.rn") == F.col("x.rn"), "TAKE_PROFIT").when(F.col("sl.rn") == F.col("x.rn"), "STOP_LOSS")
              .otherwise("TIMEOUT"))
    return grid.withColumn("x", x).select(
        "mint", signal_us, "entry_us", ((F.col("i") * len(sls) + F.col("j")) * len(holds) + F.col("k")).alias("exit_id"),
        F.col("x.bar_us").alias("exit_us"), F.col("x.pnl").alias("pnl_sol"), reason.alias("exit_reason"))
