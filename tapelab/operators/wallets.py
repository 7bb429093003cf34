"""Wallet positions, roll-ups, selection, first buys, behaviour profiles, arrival ranks, order-size entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapelab.functions.exprs import count_if, safe_div, sum_if
from tapelab.functions.pool_amm import LAMPORTS
from tapelab.operators.asof import asof_backward, salted_join
from tapelab.operators.scan import arrival_rank, quantiles_of

TX_COST = 0.0032


def positions(tape: DataFrame, until: Column | None = None) -> DataFrame:
    """Per (wallet, mint): first buy, last sell, amounts, counts, spread of buy sizes, before ``until``."""
    rows = tape if until is None else tape.where(F.col("event_time") < until)
    buy, sell = F.col("is_buy"), ~F.col("is_buy")
    bought = F.when(buy, F.col("sol_amount"))
    return rows.groupBy(F.col("user_wallet").alias("wallet"), "mint").agg(
        F.min(F.when(buy, F.col("event_time"))).alias("first_buy_at"),
        F.max(F.when(sell, F.col("event_time"))).alias("last_sell_at"),
        F.sum(bought).alias("buy_sol"), sum_if(sell, F.col("sol_amount")).alias("sell_sol"),
        sum_if(buy, F.col("token_amount")).alias("bought_tokens"), sum_if(sell, F.col("token_amount")).alias("sold_tokens"),
        count_if(buy).alias("buys"), count_if(sell).alias("sells"),
        F.stddev_samp(bought).alias("buy_size_std"), F.avg(bought).alias("average_buy_sol"))


def closed_positions(pos: DataFrame, low: float = 0.75, high: float = 1.30, tx_cost: float = TX_COST) -> DataFrame:
    """Positions sold after they were bought, in about the size bought."""
    ratio = safe_div(F.col("sold_tokens"), F.col("bought_tokens"))
    return pos.where((F.col("last_sell_at") > F.col("first_buy_at")) & ratio.between(low, high)).withColumns({
        "pnl_sol": F.col("sell_sol") - F.col("buy_sol") - (F.col("buys") + F.col("sells")) * tx_cost,
        "hold_seconds": (F.unix_micros("last_sell_at") - F.unix_micros("first_buy_at")) / 1e6,
        "closure_ratio": ratio,
        "buy_size_cv": F.coalesce(safe_div(F.col("buy_size_std"), F.col("average_buy_sol")), F.lit(0.0))})


def _totals() -> list[Column]:
    pnl = F.col("pnl_sol")
    return [
        F.count(F.lit(1)).alias("closed_positions"), F.sum(pnl).alias("pnl_sol"),
        (count_if(pnl > 0) / F.count(F.lit(1))).alias("win_rate"), F.avg("buy_size_cv").alias("mean_buy_size_cv"),
        F.max(pnl).alias("largest_position_pnl"), F.sum(F.greatest(pnl, F.lit(0.0))).alias("gross_profit"),
        F.sum(F.least(pnl, F.lit(0.0))).alias("gross_loss")]


def wallet_rollup(closed: DataFrame) -> DataFrame:
    """Totals and exact medians per wallet, for wallets of any size.

    A closed position is one (wallet, mint), so positions count distinct mints as well.
    """
    base = closed.groupBy("wallet").agg(*_totals()).withColumn("distinct_mints", F.col("closed_positions"))
    middle = quantiles_of(closed, ["wallet"], {"hold": (F.col("hold_seconds"), {"median_hold_seconds": 0.5}),
                                               "size": (F.col("average_buy_sol"), {"median_buy_sol": 0.5})})
    return base.join(middle, "wallet")


def select_wallets(closed: DataFrame, min_positions: int = 10, max_positions: int = 250, hold_s: tuple = (3, 900),
                   min_cv: float = 0.10, max_share: float = 0.60, top: int = 250) -> DataFrame:
    """Wallets with a steady closed record, best PnL first.

    Position counts are checked before medians are taken, so every median is over at most ``max_positions`` values.
    """
    counts = closed.groupBy("wallet").agg(*_totals())
    share = safe_div(F.col("largest_position_pnl"), F.col("gross_profit"))
    fit = counts.where(F.col("closed_positions").between(min_positions, max_positions) & (F.col("pnl_sol") > 0)
                       & (F.col("mean_buy_size_cv") >= min_cv) & (share <= max_share))
    medians = (closed.join(fit.select("wallet"), "wallet", "left_semi").groupBy("wallet")
               .agg(F.percentile("hold_seconds", 0.5).alias("median_hold_seconds"),
                    F.percentile("average_buy_sol", 0.5).alias("median_buy_sol")))
    return (fit.join(medians, "wallet").where(F.col("median_hold_seconds").between(*hold_s))
            .withColumns({"largest_profit_share": share, "distinct_mints": F.col("closed_positions"),
                          "profit_factor": safe_div(F.col("gross_profit"), F.abs("gross_loss"))})
            .orderBy(F.col("pnl_sol").desc(), F.col("wallet")).limit(top))


def wallet_ranks(selected: DataFrame) -> DataFrame:
    """Rank by PnL. ``selected`` is a top-k result of a few hundred rows, so one global order is safe."""
    w = Window.orderBy(F.col("pnl_sol").desc(), F.col("wallet"))
    return selected.select("wallet", F.row_number().over(w).alias("wallet_rank"))


def first_buys(tape: DataFrame, wallets: DataFrame) -> DataFrame:
    """First buy per (wallet, mint) of the given wallets."""
    names = wallets.select(F.col("wallet").alias("user_wallet")).distinct()
    return (salted_join(tape.where(F.col("is_buy")), names, ["user_wallet"], ["mint", "id"], how="left_semi")
            .groupBy(F.col("user_wallet").alias("wallet"), "mint").agg(
        F.min(F.struct("event_time", "id", "sol_amount")).alias("f"))
        .select("wallet", "mint", F.col("f.event_time").alias("first_buy_at"), F.col("f.sol_amount").alias("first_buy_sol")))


def bars_at_first_buy(buys: DataFrame, bars: DataFrame, tolerance_us: int, columns: list[str],
                      strict: bool = False, width_us: int = 1_000_000) -> DataFrame:
    """The latest bar at or before each first buy, no older than the tolerance.

    The matched bar is normally the bar that contains the buy itself; with ``strict`` only bars that had closed
    before the buy count.
    """
    right = bars.select("mint", F.unix_micros("bucket").alias("bucket_us"), *columns)
    lead = width_us if strict else 0
    out = asof_backward(buys.withColumn("t_us", F.unix_micros("first_buy_at") - lead), right, ["mint"], F.col("t_us"),
                        F.col("bucket_us"), [], "bar", tolerance=tolerance_us)
    return out.select("wallet", "mint", "first_buy_at", "first_buy_sol", *[F.col("bar")[c].alias(c) for c in ["bucket_us", *columns]])


def behavior_profile(matched: DataFrame, medians: list[str], quantiles: dict[str, tuple]) -> DataFrame:
    """One row: count, medians and quantile arrays, exact without gathering the values in one place."""
    names = {c: {f"median_{c}": 0.5} for c in medians}
    for c, probs in quantiles.items():
        names.setdefault(c, {}).update({f"{c}_{i}": p for i, p in enumerate(probs)})
    # Without any row all quantiles are NULL and the count is 0.
    count = matched.agg(F.count(F.lit(1)).alias("first_buys"))
    row = quantiles_of(matched, [], {c: (F.col(c), n) for c, n in names.items()})
    arrays = [F.array(*[f"{c}_{i}" for i in range(len(probs))]).alias(f"{c}_quantiles") for c, probs in quantiles.items()]
    return row.select(count.scalar().alias("first_buys"), *[f"median_{c}" for c in medians], *arrays)


# ---- pool swap tapes -------------------------------------------------------------------------------------------

def valid_swaps(swaps: DataFrame) -> DataFrame:
    """Rows a wallet study can use, with observed time and SOL amount."""
    ok = (F.col("user").isNotNull() & (F.col("user") != "") & F.col("pool").isNotNull() & (F.col("pool") != "")
          & F.col("side").isNotNull() & (F.col("side") != "") & F.col("quoteAmountRaw").isNotNull())
    return swaps.where(ok).withColumns({
        "observed_ms": F.coalesce(F.col("receivedAtMs"), F.col("timestamp") * 1000),
        "quote_sol": F.col("quoteAmountRaw").cast("double") / LAMPORTS})


def buyer_ranks(swaps: DataFrame) -> DataFrame:
    """Arrival rank of each distinct buyer in a pool."""
    first = swaps.where(F.col("side") == "buy").groupBy("pool", "user").agg(
        F.min(F.struct("observed_ms", "slot", "receivedSequence")).alias("f"))
    flat = first.select("pool", "user", F.col("f.observed_ms").alias("first_ms"), F.col("f.slot").alias("slot"),
                        F.col("f.receivedSequence").alias("seq"))
    out = arrival_rank(flat, ["pool"], [F.col("first_ms"), F.col("slot"), F.col("seq")], "rank")
    return out.select("pool", "user", "first_ms", "rank")


def size_entropy(swaps: DataFrame) -> DataFrame:
    """Shannon entropy in bits of buy sizes rounded to 0.01 SOL, per wallet."""
    bucket = F.floor(F.col("quote_sol") * 100 + 0.5)
    counts = (swaps.where(F.col("side") == "buy").groupBy("user", bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")))
    c = F.col("c").cast("double")
    agg = counts.groupBy("user").agg(F.sum(c).alias("n"), F.sum(c * F.log2(c)).alias("s"))
    return agg.select("user", (F.log2("n") - F.col("s") / F.col("n")).alias("buy_size_entropy_bits"))


def wallet_tape_profile(swaps: DataFrame, tx_cost: float = TX_COST, early_rank: int = 20) -> DataFrame:
    """Activity profile per wallet over a swap tape: (wallet, pool) first, then wallet."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    pool_first = swaps.groupBy("pool").agg(F.min("observed_ms").alias("pool_first_ms"))
    per_pool = swaps.groupBy("user", "pool").agg(
        F.count(F.lit(1)).alias("events"), count_if(buy).alias("buys"), count_if(sell).alias("sells"),
        F.min(F.when(buy, F.col("observed_ms"))).alias("first_buy_ms"), F.max(F.when(sell, F.col("observed_ms"))).alias("last_sell_ms"),
        F.sum(F.when(sell, F.col("quote_sol")).otherwise(-F.col("quote_sol"))).alias("flow"))
    ranks = buyer_ranks(swaps).select("pool", "user", "rank")
    trip = F.col("last_sell_ms") >= F.col("first_buy_ms")
    pp = (salted_join(per_pool.join(ranks, ["pool", "user"], "left"), pool_first, ["pool"], ["user"])
          .withColumns({"delay_ms": F.col("first_buy_ms") - F.col("pool_first_ms"),
                        "hold_s": F.when(trip, (F.col("last_sell_ms") - F.col("first_buy_ms")) / 1000.0)}))
    base = pp.groupBy("user").agg(
        F.sum("events").alias("events"), F.count(F.lit(1)).alias("distinct_pools"), F.sum("buys").alias("buys"),
        F.sum("sells").alias("sells"), F.count("hold_s").alias("round_trips"), count_if(F.col("rank") <= early_rank).alias("early_pools"),
        F.sum("flow").alias("gross_quote_flow_sol"))
    # Per-pool metrics and buy sizes as rows of one table, so that all medians are one scan.
    per_user = pp.select("user", "rank", "delay_ms", "hold_s", F.lit(None).cast("double").alias("buy_sol")).unionByName(
        swaps.where(buy).select("user", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("delay_ms"),
                                F.lit(None).cast("double").alias("hold_s"), F.col("quote_sol").alias("buy_sol")))
    middle = quantiles_of(per_user, ["user"], {
        "rank": (F.col("rank"), {"median_first_buy_rank": 0.5}), "delay": (F.col("delay_ms"), {"median_first_buy_delay_ms": 0.5}),
        "size": (F.col("buy_sol"), {"median_buy_sol": 0.5}), "hold": (F.col("hold_s"), {"median_hold_seconds": 0.5})})
    out = (base.join(middle, "user", "left")
           .join(size_entropy(swaps), "user", "left").fillna({"buy_size_entropy_bits": 0.0}))
    return out.withColumns({
        "early_pool_rate": F.when(F.col("buys") > 0, F.col("early_pools") / F.col("distinct_pools")).otherwise(F.lit(0.0)),
        "estimated_net_flow_sol": F.col("gross_quote_flow_sol") - F.col("events") * tx_cost,
    }).withColumn("manual_likelihood", manual_likelihood())


def manual_likelihood() -> Column:
    """Heuristic in [0, 1]: varied sizes, real holds, round trips, enough buys."""
    one = F.lit(1.0)
    score = (0.45 * F.least(one, F.col("buy_size_entropy_bits") / 2.5)
             + 0.25 * F.least(one, F.coalesce("median_hold_seconds", F.lit(0.0)) / 90)
             + 0.15 * F.least(one, F.col("round_trips") / F.greatest(F.col("distinct_pools"), F.lit(1)))
             + 0.15 * F.when(F.col("buys") >= 3, 1.0).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(one, score))


def rank_wallets(profile: DataFrame, min_pools: int = 2, min_buys: int = 2, top: int = 250) -> DataFrame:
    return (profile.where((F.col("distinct_pools") >= min_pools) & (F.col("buys") >= min_buys))
            .orderBy(F.col("early_pools").desc(), F.col("distinct_pools").desc(), F.col("manual_likelihood").desc(), F.col("user"))
            .limit(top))


def swap_tape_summary(swaps: DataFrame, profile: DataFrame, min_pools: int = 2, min_buys: int = 2) -> DataFrame:
    head = swaps.agg(F.count(F.lit(1)).alias("event_count"), F.min("observed_ms").alias("observed_start_ms"),
                     F.max("observed_ms").alias("observed_end_ms"))
    counts = profile.agg(F.count(F.lit(1)).alias("w"), count_if((F.col("distinct_pools") >= min_pools) & (F.col("buys") >= min_buys)).alias("e"))
    return head.withColumns({"wallet_count": counts.select("w").scalar(), "eligible_count": counts.select("e").scalar()})
