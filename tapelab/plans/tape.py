"""Tape queries: cleaning, rejections, manifests, token dimension, history, bars, trailing features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapelab.operators import bars as B, clean as C
from tapelab.plans import oracle_sql as S
from tapelab.plans.oracle_sql import r
from tapelab.plans.registry import epoch_us, query, r6
from tapelab.session import cut_lineage
from tapelab.sources import adapters as A

RULES = C.CleanRules(system_wallet=A.SYSTEM_WALLET)
DAY_S = 86_400.0


def clean(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_tape(A.raw_tape(spark, d), RULES)


def token_table(tape: DataFrame) -> DataFrame:
    return C.token_dim(A.token_source(tape), tape)


def bar_table(spark: SparkSession, d: str, tape: DataFrame | None = None) -> DataFrame:
    return B.bars(clean(spark, d) if tape is None else tape, A.HOUR_S, DAY_S)


def derived_table(spark: SparkSession, d: str, tape: DataFrame | None = None) -> DataFrame:
    return B.derived(B.trailing(bar_table(spark, d, tape), A.HOUR_S))


def staged_tape(spark: SparkSession, d: str) -> DataFrame:
    """The clean tape written once, for plans that read it several times."""
    return cut_lineage(clean(spark, d))


def feature_table(spark: SparkSession, d: str, tape: DataFrame | None = None) -> DataFrame:
    tape = staged_tape(spark, d) if tape is None else tape
    return B.feature_table(tape, token_table(tape), A.HOUR_S, DAY_S)


@query("clean_tape", f"""WITH {S.TAPE}
SELECT id, mint, tx_signature, event_us, {r('seconds_since_launch', 'seconds_since_launch')}, is_buy,
  {r('sol_amount', 'sol_amount')}, {r('token_amount', 'token_amount')}, user_wallet, v_tokens_bonding_curve,
  v_sol_bonding_curve, {r('market_cap_sol', 'market_cap_sol')}, {r('curve_pct_depleted', 'curve_pct_depleted')}
FROM tape WHERE event_us >= (SELECT max(event_us) - 7 * 86400000000 FROM raw_tape)""")
def clean_tape(spark, d):
    tape = C.clean_tape(C.last_window(A.raw_tape(spark, d), 7), RULES)
    return tape.select(
        "id", "mint", "tx_signature", epoch_us("event_time").alias("event_us"),
        r6("seconds_since_launch").alias("seconds_since_launch"), "is_buy", r6("sol_amount").alias("sol_amount"),
        r6("token_amount").alias("token_amount"), "user_wallet", "v_tokens_bonding_curve", "v_sol_bonding_curve",
        r6("market_cap_sol").alias("market_cap_sol"), r6("curve_pct_depleted").alias("curve_pct_depleted"))


@query("tape_rejections", f"""WITH {S.RAW}
SELECT CASE
  WHEN user_wallet = 'system' THEN 'system_wallet'
  WHEN sol_amount IS NULL OR price_sol IS NULL OR token_amount IS NULL THEN 'missing_amount'
  WHEN NOT (sol_amount > 0 AND token_amount > 0 AND price_sol > 0) THEN 'not_positive'
  WHEN NOT coalesce(sol_amount / nullif(token_amount * price_sol, 0) BETWEEN 0.01 AND 100, false) THEN 'inconsistent_ratio'
  WHEN NOT (curve_pct_depleted BETWEEN 0 AND 100) THEN 'curve_out_of_range'
  WHEN NOT (seconds_since_launch >= 0) THEN 'before_launch' ELSE 'kept' END AS verdict, count(*) AS n
FROM raw_tape GROUP BY 1""")
def tape_rejections(spark, d):
    return C.rejection_report(A.raw_tape(spark, d), RULES)


@query("tape_manifest", f"""WITH {S.TAPE}
SELECT count(*) AS trades, count(DISTINCT mint) AS mints, count(DISTINCT user_wallet) AS wallets,
  min(event_us) AS observed_start, max(event_us) AS observed_end,
  count(*) FILTER (WHERE is_buy) AS buys, count(*) FILTER (WHERE NOT is_buy) AS sells FROM tape""")
def tape_manifest(spark, d):
    return C.tape_manifest(clean(spark, d)).withColumns(
        {"observed_start": epoch_us("observed_start"), "observed_end": epoch_us("observed_end")})


@query("bars_manifest", f"""WITH {S.BARS}
SELECT count(*) AS bars, count(DISTINCT mint) AS mints, min(bucket_s) AS first_bucket, max(bucket_s) AS last_bucket FROM bars""")
def bars_manifest(spark, d):
    return C.bars_manifest(bar_table(spark, d)).withColumns(
        {"first_bucket": F.unix_seconds("first_bucket"), "last_bucket": F.unix_seconds("last_bucket")})


@query("token_dim", f"""WITH {S.TOKEN_SOURCE}
SELECT * REPLACE (round(initial_market_cap_sol, 6) + 0.0 AS initial_market_cap_sol) FROM tokens""")
def token_dim(spark, d):
    return token_table(staged_tape(spark, d)).select(
        epoch_us("detected_at").alias("detected_us"), "*",
    ).drop("detected_at").withColumn("initial_market_cap_sol", r6("initial_market_cap_sol"))


@query("wallet_history", f"""WITH {S.SWAPS}
SELECT usr AS "user", receivedAtMs, receivedSequence, pool, side, quoteAmountRaw FROM swaps
WHERE receivedAtMs BETWEEN (SELECT min(receivedAtMs) + 86400000 FROM swaps) AND (SELECT max(receivedAtMs) - 86400000 FROM swaps)
  AND usr IN (SELECT usr FROM swaps GROUP BY usr HAVING count(*) FILTER (WHERE side = 'buy') > 2 * count(*) FILTER (WHERE side = 'sell'))""")
def wallet_history(spark, d):
    sw = A.pool_swaps(spark, d)
    chosen = sw.groupBy(F.col("user").alias("wallet")).agg(
        F.count(F.when(F.col("side") == "buy", 1)).alias("b"), F.count(F.when(F.col("side") == "sell", 1)).alias("s")
    ).where(F.col("b") > 2 * F.col("s"))
    ends = sw.agg(F.min("receivedAtMs").alias("lo"), F.max("receivedAtMs").alias("hi"))
    out = C.wallet_history(sw, chosen, ends.select("lo").scalar() + 86_400_000, ends.select("hi").scalar() - 86_400_000,
                           "receivedAtMs")
    return out.select("user", "receivedAtMs", "receivedSequence", "pool", "side", "quoteAmountRaw")


@query("unprocessed_events", f"""WITH {S.SWAPS}
SELECT signature, pool FROM swaps WHERE signature NOT IN (SELECT signature FROM swaps WHERE side = 'sell')""")
def unprocessed_events(spark, d):
    sw = A.pool_swaps(spark, d)
    return C.unprocessed(sw, sw.where(F.col("side") == "sell")).select("signature", "pool")


_BAR_LONGS = ["buys", "sells", "buyers", "sellers", "v_tokens_close", "v_sol_close"]
_BAR_DOUBLES = ["age_seconds", "buy_sol", "sell_sol", "largest_buy_sol", "largest_sell_sol", "mc_open", "mc_close",
                "mc_high", "mc_low", "curve_close"]


@query("bars", f"""WITH {S.BARS}
SELECT mint, bucket_s, {', '.join(_BAR_LONGS)}, last_event_us, {', '.join(r(c, c) for c in _BAR_DOUBLES)} FROM bars""")
def bars(spark, d):
    return bar_table(spark, d).select(
        "mint", F.unix_seconds("bucket").alias("bucket_s"), *_BAR_LONGS, epoch_us("last_event_time").alias("last_event_us"),
        *[r6(c).alias(c) for c in _BAR_DOUBLES])


_TRAIL_LONGS = ["buys_2s", "sells_2s", "buyer_seconds_2s", "seller_seconds_2s", "buys_5s", "sells_5s", "buyer_seconds_5s",
                "seller_seconds_5s", "buys_15s", "sells_15s", "buyer_seconds_15s"]
_TRAIL_DOUBLES = ["buy_sol_2s", "sell_sol_2s", "buy_sol_5s", "sell_sol_5s", "buy_sol_15s", "sell_sol_15s", "peak_mc_60s",
                  "low_mc_15s", "mc_5s_ago", "mc_15s_ago", "previous_mc_close"]


@query("trailing_features", f"""WITH {S.FEATURES}
SELECT mint, bucket_s, {', '.join(_TRAIL_LONGS)}, {', '.join(r(c, c) for c in _TRAIL_DOUBLES)} FROM trails""")
def trailing_features(spark, d):
    return B.trailing(bar_table(spark, d), A.HOUR_S).select(
        "mint", F.unix_seconds("bucket").alias("bucket_s"), *_TRAIL_LONGS, *[r6(c).alias(c) for c in _TRAIL_DOUBLES])


_DERIVED = ["prior_buy_sol_5_to_15s", "prior_sell_sol_5_to_15s", "return_5s", "return_15s", "drawdown_from_60s_peak",
            "bounce_from_15s_low", "one_bar_return"]
_DIM_DOUBLES = ["initial_buy_sol", "initial_market_cap_sol", "initial_top1_pct_corrected", "initial_top5_pct_corrected",
                "initial_top10_pct_corrected", "dev_buy_pct_corrected", "initial_gini"]
_DIM_OTHER = ["is_mayhem_mode", "creator_past_tokens", "creator_past_rugs", "initial_holder_count", "is_cashback_enabled"]


@query("feature_table", f"""WITH {S.FEATURES}
SELECT mint, bucket_s, prior_buys_5_to_15s, prior_buyer_seconds_5_to_15s, {', '.join(r(c, c) for c in _DERIVED + _DIM_DOUBLES)},
  {', '.join(_DIM_OTHER)} FROM features""")
def features(spark, d):
    return feature_table(spark, d).select(
        "mint", F.unix_seconds("bucket").alias("bucket_s"), "prior_buys_5_to_15s", "prior_buyer_seconds_5_to_15s",
        *[r6(c).alias(c) for c in _DERIVED + _DIM_DOUBLES], *_DIM_OTHER)
