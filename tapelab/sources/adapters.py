"""Canonical market tables derived from the generic driver tables.

A deployment reads real tapes with ``tables.read_tape``. These adapters let every operator run on the given
tables at any scale: `events` becomes a bonding-curve trade tape with integer money, so sums do not depend on
the order of addition. One source hour plays the role of one market second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapelab.functions.exprs import floor_div
from tapelab.operators.scan import Running, running

# Fixed values of the adapter.
START_LAMPORTS = 30_000_000_000
INVARIANT = "32190000000000000000000000"
LAMPORTS_PER_CENT = 100_000
VIRTUAL_QUOTE = 2_000_000_000
SUPPLY_RAW = 1_000_000_000_000_000
CURVE_LOCKED_TOKENS = 279_900_000_000_000
SYSTEM_WALLET = "system"
HOUR_S = 3_600
HOUR_MS = 3_600_000
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz_micros(ts: Column) -> Column:
    """Epoch microseconds of a zone-less timestamp from its calendar fields, whatever the session time zone."""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (F.unix_date(ts.cast("date")).cast("long") * F.lit(86_400_000_000).cast("long") + minutes.cast("long") * F.lit(60_000_000).cast("long")
            + (seconds * 1_000_000).cast("long"))


def div(a: Column, b: Column) -> Column:
    """Integer division; callers keep the quotient inside BIGINT."""
    return F.call_function("div", a, b)


def curve_tokens(v_sol: Column) -> Column:
    """Raw token reserve on the constant-product curve at a lamport reserve."""
    return div(F.lit(INVARIANT).cast("decimal(38,0)"), v_sol)


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exact curve trades: lamport reserves before and after each one, in (mint, time, id) order."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = ev.select(
        F.col("event_id").alias("id"),
        ntz_micros(F.col("ts")).alias("t_us"),
        (k % 20).alias("k20"),
        F.date_format("ts", "yyyyMMdd").alias("day"),
        F.col("user_id"),
        F.col("event_type").isin("purchase", "click", "signup").alias("is_buy"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    ).withColumns({
        "mint": F.concat(F.lit("m"), F.col("k20"), F.lit("-"), F.col("day")),
        "delta": F.when(F.col("is_buy"), F.col("cents")).otherwise(-F.col("cents")) * F.lit(LAMPORTS_PER_CENT),
    })
    out = running(rows, ["mint"], [F.col("t_us"), F.col("id")],
                  [Running("moved", "sum", F.col("delta"))], first={"launch_us": F.col("t_us")})
    out = out.withColumn("v_sol", F.lit(START_LAMPORTS) + F.col("moved"))
    out = out.withColumn("v_sol_before", F.col("v_sol") - F.col("delta"))
    return out.withColumns({
        "v_tok": curve_tokens(F.col("v_sol")),
        "v_tok_before": curve_tokens(F.col("v_sol_before")),
        "tok": F.col("k20") * 1000 + F.col("day").cast("long") % 100,
    })


def raw_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade tape with the defects a cleaning step must catch, seeded by id."""
    b = base_events(spark, sf_dir)
    price = (F.col("v_sol") / 1e9) / (F.col("v_tok") / 1e6)
    sol = F.col("cents") / 10000.0
    hit = lambda m, r: F.col("id") % m == r
    return b.select(
        "id", "mint",
        F.concat(F.lit("s"), F.col("id")).alias("tx_signature"),
        F.timestamp_micros("t_us").alias("event_time"),
        F.when(hit(113, 17), F.lit(-5.0)).otherwise((F.col("t_us") - F.col("launch_us")) / 1e6)
        .alias("seconds_since_launch"),
        "is_buy",
        F.when(~hit(101, 7), sol).alias("sol_amount"),
        (F.floor(sol / price) * F.when(hit(107, 11), 100000.0).otherwise(1.0)).alias("token_amount"),
        F.when(F.col("user_id") % 50 == 49, F.lit(SYSTEM_WALLET))
        .otherwise(F.concat(F.lit("w"), F.col("user_id"))).alias("user_wallet"),
        F.col("v_tok").alias("v_tokens_bonding_curve"),
        F.col("v_sol").alias("v_sol_bonding_curve"),
        (price * 1e9).alias("market_cap_sol"),
        F.when(hit(103, 9), F.lit(0.0)).otherwise(price).alias("price_sol"),
        F.when(hit(109, 13), F.lit(140.0)).otherwise(F.col("v_sol") / 85e9 * 100).alias("curve_pct_depleted"),
        F.lit("events").alias("source"),
        "tok",
    )


def token_source(tape: DataFrame) -> DataFrame:
    """A token table for the tape's mints: first buyer as creator, attributes by a rule on the token number."""
    order = F.struct("event_time", "id")
    t = F.col("tok")
    top1 = (t % 13) + 1.5
    return tape.groupBy("mint", "tok").agg(
        F.min("event_time").alias("detected_at"),
        F.min_by("user_wallet", F.when(F.col("is_buy"), order)).alias("creator"),
        F.min_by("sol_amount", F.when(F.col("is_buy"), order)).alias("initial_buy_sol"),
        F.min_by("market_cap_sol", order).alias("initial_market_cap_sol"),
    ).select(
        "mint", "detected_at",
        F.concat(F.lit("Token "), t).alias("name"),
        F.concat(F.lit("T"), t).alias("symbol"),
        (t % 5 == 0).alias("is_mayhem_mode"),
        "creator",
        (t % 7).alias("creator_past_tokens"),
        (t % 3).alias("creator_past_rugs"),
        "initial_buy_sol", "initial_market_cap_sol",
        (t % 40 + 2).alias("initial_holder_count"),
        top1.alias("initial_top1_pct_corrected"),
        (top1 * 2).alias("initial_top5_pct_corrected"),
        F.when(t % 23 != 0, top1 * 2.5).alias("initial_top10_pct_corrected"),
        (t % 9).cast("double").alias("dev_buy_pct_corrected"),
        ((t % 17) / 20.0).alias("initial_gini"),
        (t % 2 == 0).alias("is_cashback_enabled"),
        F.when(t % 4 != 0, t % 11 == 0).alias("top10_pct_suspect"),
    )


def pool_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool swap events: reserves before the swap, amounts, fees."""
    b = base_events(spark, sf_dir)
    amount = F.abs("delta")
    return b.select(
        F.concat(F.lit("s"), F.col("id")).alias("signature"),
        floor_div(F.col("t_us"), 400000).alias("slot"),
        floor_div(F.col("t_us"), 1000).alias("receivedAtMs"),
        F.col("id").alias("receivedSequence"),
        F.when(F.col("is_buy"), F.lit("buy")).otherwise(F.lit("sell")).alias("side"),
        floor_div(F.col("t_us"), 1000000).alias("timestamp"),
        F.abs(F.col("v_tok") - F.col("v_tok_before")).alias("baseAmountRaw"),
        F.col("v_tok_before").alias("baseReserveRaw"),
        F.col("v_sol_before").alias("quoteReserveRaw"),
        amount.alias("quoteAmountRaw"),
        F.when(F.col("id") % 5 != 0, amount).alias("quoteReserveDeltaRaw"),
        F.when(F.col("id") % 7 != 0, amount).alias("userQuoteAmountRaw"),
        F.lit(VIRTUAL_QUOTE).cast("long").alias("virtualQuoteReservesRaw"),
        F.when(F.col("id") % 3 != 0, F.lit(SUPPLY_RAW).cast("long")).alias("baseSupplyRaw"),
        F.lit(20).alias("lpFeeBasisPoints"),
        F.lit(5).alias("protocolFeeBasisPoints"),
        F.lit(0).alias("coinCreatorFeeBasisPoints"),
        F.lit(95).alias("cashbackFeeBasisPoints"),
        F.col("mint").alias("pool"),
        F.concat(F.lit("w"), F.col("user_id")).alias("user"),
        F.lit(None).cast("string").alias("coinCreator"),
    )


def migrations(swaps: DataFrame) -> DataFrame:
    """One migration per pool, at the second of its first swap."""
    return swaps.groupBy("pool").agg(
        F.min("timestamp").alias("blockTime"),
        F.min("receivedSequence").alias("migrationLogReceivedSequence"),
    ).select(
        "pool", F.col("pool").alias("mint"), "blockTime",
        (F.col("blockTime") * 1000 + 200).alias("migrationLogReceivedAtMs"),
        "migrationLogReceivedSequence",
        (F.col("blockTime") * 1000 + 450).alias("migrationResolvedAtMs"),
        F.lit(250).cast("long").alias("migrationResolutionMs"),
        F.concat(F.lit("sym-"), F.col("pool")).alias("symbol"),
        F.lit(SUPPLY_RAW).cast("long").alias("totalSupplyRaw"),
    )


def curve_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live curve trades: reserves after the trade."""
    b = base_events(spark, sf_dir)
    return b.select(
        F.concat(F.lit("s"), F.col("id")).alias("signature"),
        floor_div(F.col("t_us"), 400000).alias("slot"),
        floor_div(F.col("t_us"), 1000).alias("receivedAtMs"),
        F.col("id").alias("receivedSequence"),
        "mint",
        F.when(F.col("user_id") % 50 == 49, F.lit(SYSTEM_WALLET))
        .otherwise(F.concat(F.lit("w"), F.col("user_id"))).alias("user"),
        F.col("is_buy").alias("isBuy"),
        F.abs("delta").alias("solAmountRaw"),
        F.abs(F.col("v_tok") - F.col("v_tok_before")).alias("tokenAmountRaw"),
        F.col("v_sol").alias("virtualSolReservesRaw"),
        F.col("v_tok").alias("virtualTokenReservesRaw"),
        (F.col("v_sol") - START_LAMPORTS).alias("realSolReservesRaw"),
        (F.col("v_tok") - CURVE_LOCKED_TOKENS).alias("realTokenReservesRaw"),
        F.lit(95).alias("feeBasisPoints"),
        F.when(F.col("tok") % 2 == 0, F.lit(5)).otherwise(F.lit(30)).alias("creatorFeeBasisPoints"),
        (F.col("tok") % 5 == 0).alias("mayhemMode"),
    )


def holder_balances(tape: DataFrame) -> DataFrame:
    """Net token balances per (mint, wallet); the lexically last wallet of a rule plays the curve account."""
    net = tape.groupBy("mint", "tok", F.col("user_wallet").alias("address")).agg(
        F.sum(F.when(F.col("is_buy"), F.col("token_amount")).otherwise(-F.col("token_amount")))
        .cast("long").alias("amount"))
    n = F.substring("address", 2, 12).cast("long")
    return net.select("mint", "address", "amount", (F.col("tok") % 5 == 0).alias("mayhem_mode"),
                      (n % 10 == 3).alias("is_curve_account"), (n % 10 == 4).alias("is_creator_account"))
