"""Pool event operators: opening windows, running drawdown, trade pressure, trailing event features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapelab.functions.exprs import count_if, safe_div
from tapelab.functions.gates import DumpGuard
from tapelab.functions.pool_amm import LAMPORTS, pool_after, quote_sol, spot_mcap
from tapelab.operators.asof import asof_backward, asof_forward, interval_join, salted_join
from tapelab.operators.scan import Cells, Running, equal_cells, running

def swap_order() -> list[Column]:
    return [F.col("receivedAtMs"), F.col("receivedSequence")]


ZERO_OPENING = {"opening_swaps": 0, "independent_buyers": 0, "largest_opening_swap_sol": 0.0, "buys_sol": 0.0, "sells_sol": 0.0}


def opening_totals(opened: DataFrame, keys: list[str]) -> DataFrame:
    """Reserve before the first swap, flows, largest swap and distinct buyers per key; two aggregations, so it also runs on a stream.

    ``opened``: the swaps of each opening window. Rows without a swap (``timestamp`` null) keep their key alive and count nothing.
    Buyers are counted per (key, user) first: a busy pool spreads over its users.
    """
    buy = F.col("side") == "buy"
    per_user = opened.groupBy(*keys, "user").agg(
        F.sum(F.when(buy, quote_sol())).alias("buys"), F.sum(F.when(~buy, quote_sol())).alias("sells"),
        count_if(buy).alias("n_buys"), F.max(quote_sol()).alias("largest"), F.count("timestamp").alias("n"),
        F.min(F.struct("receivedAtMs", "receivedSequence", "quoteReserveRaw")).alias("first"))
    return per_user.groupBy(*keys).agg(
        (F.min("first")["quoteReserveRaw"].cast("double") / LAMPORTS).alias("quote_reserve_sol"),
        F.sum("n").alias("opening_swaps"), count_if(F.col("n_buys") > 0).alias("independent_buyers"),
        F.max("largest").alias("largest_opening_swap_sol"), F.sum("buys").alias("buys_sol"), F.sum("sells").alias("sells_sol"))


def opening_window(migrations: DataFrame, swaps: DataFrame, seconds: int) -> DataFrame:
    """Per migration: what happened in [migration, migration + seconds], at second grain, both ends inclusive.

    Migrations without swaps keep a row with NULL reserve and zero counts.
    """
    opened = interval_join(migrations.select("pool", "blockTime"), swaps, ["pool"], F.col("blockTime"),
                           F.col("blockTime") + seconds, F.col("timestamp"))
    return (migrations.join(opening_totals(opened, ["pool"]), "pool", "left").fillna(ZERO_OPENING)
            .withColumn("net_flow_sol", F.col("buys_sol") - F.col("sells_sol")))


def tape_completeness(migrations: DataFrame, swaps: DataFrame, decided_ms: Column, pre_cap: int = 500, candidate_cap: int = 5_000,
                      slack_s: int = 2) -> DataFrame:
    """Events that a bounded live buffer would have dropped per pool until its decision: before the migration, and from slack_s before it on.

    A report only: nothing is dropped here, so the counts decide nothing. Events received after ``decided_ms`` do not count.
    """
    m = migrations.select("pool", "blockTime", decided_ms.alias("decided_ms"))
    per_cell = (salted_join(swaps, m, ["pool"], ["receivedSequence"]).where(F.col("receivedAtMs") <= F.col("decided_ms")).groupBy("pool").agg(
        count_if(F.col("timestamp") < F.col("blockTime")).alias("pre"),
        count_if(F.col("timestamp") >= F.col("blockTime") - slack_s).alias("seen")))
    over = lambda c, cap: F.greatest(F.coalesce(F.col(c), F.lit(0)) - cap, F.lit(0))
    return (m.drop("decided_ms").join(per_cell, "pool", "left")
            .select("pool", over("pre", pre_cap).alias("pre_dropped"), over("seen", candidate_cap).alias("candidate_dropped"))
            .withColumn("dropped_events", F.col("pre_dropped") + F.col("candidate_dropped")))


def running_drawdown(swaps: DataFrame, migrations: DataFrame, cells: Cells | None = None) -> DataFrame:
    """Peak and drawdown of spot market cap per swap since its pool's migration."""
    since = salted_join(swaps, migrations.select("pool", "blockTime"), ["pool"], ["receivedSequence"],
                        rows=cells.rows if cells else 0).where(F.col("timestamp") >= F.col("blockTime"))
    priced = since.withColumn("mcap_sol", spot_mcap(pool_after())).where(F.col("mcap_sol").isNotNull())
    out = running(priced, ["pool"], swap_order(), [Running("peak_mcap_sol", "max", F.col("mcap_sol"))], cells=cells)
    return out.withColumn("drawdown_pct", F.coalesce(
        100 * safe_div(F.col("peak_mcap_sol") - F.col("mcap_sol"), F.col("peak_mcap_sol")), F.lit(0.0)))


def flow_totals(swaps: DataFrame, key: str = "pool", cells: Cells | None = None) -> DataFrame:
    """Running buy and sell lamports per pool, exact in integers."""
    amount = F.coalesce("userQuoteAmountRaw", "quoteAmountRaw").cast("long")
    buy = F.col("side") == "buy"
    return running(swaps, [key], swap_order(), [
        Running("cum_buy", "sum", F.when(buy, amount).otherwise(F.lit(0).cast("long"))),
        Running("cum_sell", "sum", F.when(buy, F.lit(0).cast("long")).otherwise(amount))], cells=cells)


def flow_pressure(instants: DataFrame, swaps: DataFrame, at: str, window_ms: int, cells: Cells | None = None) -> DataFrame:
    """Buy and sell SOL in [at - window, at] per instant, both ends inclusive.

    A window sum is the difference of two running totals, each found by an as-of lookup: linear whatever the rate
    of events.
    """
    cells = cells or equal_cells(swaps, ["pool"], F.col("receivedAtMs"))
    totals = flow_totals(swaps, cells=cells).select("pool", "receivedAtMs", "receivedSequence", "cum_buy", "cum_sell")
    args = dict(keys=["pool"], right_time=F.col("receivedAtMs"), right_tie=[F.col("receivedSequence")], cells=cells)
    upto = asof_backward(instants, totals, left_time=F.col(at), payload="__upto", **args)
    both = asof_backward(upto, totals, left_time=F.col(at) - (window_ms + 1), payload="__before", **args)
    d = lambda n: (F.coalesce(F.col("__upto")[n], F.lit(0)) - F.coalesce(F.col("__before")[n], F.lit(0))) / LAMPORTS
    out = both.withColumns({"buy_sol": d("cum_buy"), "sell_sol": d("cum_sell")}).drop("__upto", "__before")
    return out.withColumn("sell_to_buy_ratio", F.when(F.col("buy_sol") > 0, safe_div(F.col("sell_sol"), F.col("buy_sol")))
                          .when(F.col("sell_sol") > 0, F.lit(None).cast("double")).otherwise(F.lit(0.0)))


def with_dump_guard(pressure: DataFrame, guard: DumpGuard = DumpGuard()) -> DataFrame:
    """Guard reasons per instant; needs drawdown_pct, buy_sol, sell_sol."""
    return pressure.withColumn("dump_reasons", guard.reasons(F.col("drawdown_pct"), F.col("buy_sol"), F.col("sell_sol")))


def event_features(events: DataFrame, unit_ms: int = 1_000) -> DataFrame:
    """Trailing features at every event, over strictly less than 2 and 5 time units, seeing only earlier receipts.

    Per event: totals so far, minus the totals just before the first event inside the frame. That first event is
    one forward as-of per frame, so no frame is ever scanned.
    """
    order = [F.col("receivedAtMs"), F.col("receivedSequence")]
    buy = F.col("isBuy")
    cells = equal_cells(events, ["mint"], F.col("receivedAtMs"))
    tot = running(events, ["mint"], order, [
        Running("cum_buys", "sum", F.when(buy, 1).otherwise(0).cast("long")),
        Running("cum_buy_raw", "sum", F.when(buy, F.col("solAmountRaw").cast("long")).otherwise(F.lit(0).cast("long")))],
        first={"first_received_ms": F.col("receivedAtMs")}, cells=cells)
    own_buys = F.when(buy, 1).otherwise(0)
    own_raw = F.when(buy, F.col("solAmountRaw").cast("long")).otherwise(F.lit(0).cast("long"))
    marks = tot.select("mint", "receivedAtMs", "receivedSequence", (F.col("cum_buys") - own_buys).alias("before_buys"),
                       (F.col("cum_buy_raw") - own_raw).alias("before_raw"), "market_cap_sol")
    args = dict(keys=["mint"], right_time=F.col("receivedAtMs"), right_tie=[F.col("receivedSequence")], cells=cells)
    two = asof_forward(tot, marks, left_time=F.col("receivedAtMs") - 2 * unit_ms + 1, payload="__two", **args)
    five = asof_forward(two, marks, left_time=F.col("receivedAtMs") - 5 * unit_ms + 1, payload="__five", **args)
    old = F.col("__five")["market_cap_sol"]
    return five.withColumns({
        "age_seconds": (F.col("receivedAtMs") - F.col("first_received_ms")) / 1000.0,
        "buys_2s": F.col("cum_buys") - F.col("__two")["before_buys"],
        "buy_sol_5s": (F.col("cum_buy_raw") - F.col("__five")["before_raw"]) / LAMPORTS,
        "return_5s": F.when(old > 0, F.col("market_cap_sol") / F.nullif(old, F.lit(0.0)) - 1),
    }).drop("__two", "__five", "cum_buys", "cum_buy_raw", "first_received_ms")
