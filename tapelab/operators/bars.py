"""Time bars per mint and trailing-window features over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapelab.functions.exprs import floor_div, max_if, order_key, ratio_minus_one, sum_if

MAX_BAR_AGE_S = 900


def bars(tape: DataFrame, width_s: int = 1, max_age_s: float = MAX_BAR_AGE_S) -> DataFrame:
    """One row per (mint, bucket) that traded; gaps are not filled.

    First step: per (mint, bucket, wallet), combined map-side, so a hot mint or second spreads over wallets and
    distinct buyers become plain counts. Second step: a few rows per bucket.
    """
    width_us = width_s * 1_000_000
    t_us = F.unix_micros("event_time")
    bucket = F.timestamp_micros(floor_div(t_us, width_us) * F.lit(width_us).cast("long"))
    buy, sell = F.col("is_buy"), ~F.col("is_buy")
    lasts = {"mc_close": "market_cap_sol", "curve_close": "curve_pct_depleted",
             "v_tokens_close": "v_tokens_bonding_curve", "v_sol_close": "v_sol_bonding_curve"}
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("at"))

    per_wallet = (tape.where(F.col("seconds_since_launch") <= max_age_s).withColumn("at", order_key(t_us, F.col("id")))
                  .groupBy("mint", bucket.alias("bucket"), "user_wallet").agg(
        F.min("seconds_since_launch").alias("age_seconds"),
        F.count(F.when(buy, 1)).alias("buys"),
        F.count(F.when(sell, 1)).alias("sells"),
        sum_if(buy, F.col("sol_amount")).alias("buy_sol"),
        sum_if(sell, F.col("sol_amount")).alias("sell_sol"),
        max_if(buy, F.col("sol_amount")).alias("largest_buy_sol"),
        max_if(sell, F.col("sol_amount")).alias("largest_sell_sol"),
        F.min_by("market_cap_sol", known("market_cap_sol")).alias("mc_open"),
        F.min(known("market_cap_sol")).alias("at_mc_open"),
        *[F.max_by(src, known(src)).alias(out) for out, src in lasts.items()],
        *[F.max(known(src)).alias(f"at_{out}") for out, src in lasts.items()],
        F.max("market_cap_sol").alias("mc_high"),
        F.min("market_cap_sol").alias("mc_low"),
        F.max("event_time").alias("last_event_time"),
    ))
    return per_wallet.groupBy("mint", "bucket").agg(
        F.min("age_seconds").alias("age_seconds"),
        F.sum("buys").alias("buys"),
        F.sum("sells").alias("sells"),
        F.count(F.when(F.col("buys") > 0, F.col("user_wallet"))).alias("buyers"),
        F.count(F.when(F.col("sells") > 0, F.col("user_wallet"))).alias("sellers"),
        F.sum("buy_sol").alias("buy_sol"),
        F.sum("sell_sol").alias("sell_sol"),
        F.max("largest_buy_sol").alias("largest_buy_sol"),
        F.max("largest_sell_sol").alias("largest_sell_sol"),
        F.min_by("mc_open", "at_mc_open").alias("mc_open"),
        *[F.max_by(out, f"at_{out}").alias(out) for out in lasts],
        F.max("mc_high").alias("mc_high"),
        F.min("mc_low").alias("mc_low"),
        F.max("last_event_time").alias("last_event_time"),
    )


def trailing(bars_df: DataFrame, width_s: int = 1) -> DataFrame:
    """Trailing features per bar over frames of 2, 5, 15 and 60 bar widths, in one sort per mint.

    Bars stop at the maximum age, so a mint has at most max_age / width + 1 of them and windows stay small
    however many trades a mint has.
    """
    by_mint = Window.partitionBy("mint").orderBy(F.unix_seconds("bucket"))
    frame = lambda n: by_mint.rangeBetween(-(n - 1) * width_s, 0)
    w2, w5, w15, w60 = frame(2), frame(5), frame(15), frame(60)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def sums(tag: str, w, sellers: bool = True) -> dict:
        out = {
            f"buys_{tag}": F.sum("buys").over(w),
            f"sells_{tag}": F.sum("sells").over(w),
            f"buyer_seconds_{tag}": F.sum("buyers").over(w),
            f"buy_sol_{tag}": F.sum(zero("buy_sol")).over(w),
            f"sell_sol_{tag}": F.sum(zero("sell_sol")).over(w),
        }
        if sellers:
            out[f"seller_seconds_{tag}"] = F.sum("sellers").over(w)
        return out

    return bars_df.withColumns({
        **sums("2s", w2), **sums("5s", w5), **sums("15s", w15, sellers=False),
        "peak_mc_60s": F.max("mc_high").over(w60),
        "low_mc_15s": F.min("mc_low").over(w15),
        "mc_5s_ago": F.first("mc_open").over(w5),
        "mc_15s_ago": F.first("mc_open").over(w15),
        "previous_mc_close": F.lag("mc_close").over(by_mint),
    })


def derived(features: DataFrame) -> DataFrame:
    """Frame differences and returns."""
    c = F.col
    return features.withColumns({
        "prior_buys_5_to_15s": c("buys_15s") - c("buys_5s"),
        "prior_buyer_seconds_5_to_15s": c("buyer_seconds_15s") - c("buyer_seconds_5s"),
        "prior_buy_sol_5_to_15s": c("buy_sol_15s") - c("buy_sol_5s"),
        "prior_sell_sol_5_to_15s": c("sell_sol_15s") - c("sell_sol_5s"),
        "return_5s": ratio_minus_one(c("mc_close"), c("mc_5s_ago")),
        "return_15s": ratio_minus_one(c("mc_close"), c("mc_15s_ago")),
        "drawdown_from_60s_peak": ratio_minus_one(c("mc_close"), c("peak_mc_60s")),
        "bounce_from_15s_low": ratio_minus_one(c("mc_close"), c("low_mc_15s")),
        "one_bar_return": ratio_minus_one(c("mc_close"), c("previous_mc_close")),
    })


TOKEN_FEATURES = [
    "is_mayhem_mode", "creator_past_tokens", "creator_past_rugs", "initial_buy_sol", "initial_market_cap_sol",
    "initial_holder_count", "initial_top1_pct_corrected", "initial_top5_pct_corrected",
    "initial_top10_pct_corrected", "dev_buy_pct_corrected", "initial_gini", "is_cashback_enabled",
]


def enrich(features: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token attributes onto bars; bars without a token row keep NULLs."""
    return features.join(tokens.select("mint", *TOKEN_FEATURES), "mint", "left")


def feature_table(tape: DataFrame, tokens: DataFrame, width_s: int = 1, max_age_s: float = MAX_BAR_AGE_S) -> DataFrame:
    return enrich(derived(trailing(bars(tape, width_s, max_age_s), width_s)), tokens)
