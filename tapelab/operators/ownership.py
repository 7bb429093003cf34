"""Ownership concentration as of a signal, and from balance snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapelab.functions.exprs import safe_div, sum_if
from tapelab.operators.asof import salted_join
from tapelab.operators.scan import Running, running

# Token supply by mode.
SUPPLY_NORMAL = 1_000_000_000.0
SUPPLY_MAYHEM = 2_000_000_000.0


def with_supply(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    supply = F.when(F.coalesce(F.col("is_mayhem_mode").cast("double"), F.lit(0.0)) > 0, SUPPLY_MAYHEM).otherwise(SUPPLY_NORMAL)
    return candidates.join(tokens.select("mint", "creator"), "mint", "left").withColumn("supply", supply)


def balances_at(signals: DataFrame, tape: DataFrame, signal_us: str = "signal_us", salts: int = 16, strict: bool = False) -> DataFrame:
    """Net balance per (mint, wallet) from all trades up to the signal.

    A mint has one signal and may have any number of trades, so trades spread over salts by wallet.
    ``strict`` leaves out trades at the signal instant itself.
    """
    sig = signals.select("mint", signal_us)
    joined = salted_join(tape.select("mint", "user_wallet", "event_time", "is_buy", "token_amount"), sig, ["mint"], ["user_wallet"], salts)
    t = F.unix_micros("event_time")
    seen = joined.where(t < F.col(signal_us) if strict else t <= F.col(signal_us))
    return seen.groupBy("mint", "user_wallet").agg(
        F.sum(F.when(F.col("is_buy"), F.col("token_amount")).otherwise(-F.col("token_amount"))).alias("balance"))


def gini(balances: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, total and Gini per key.

    Equal balances are counted first; ranks come from a running count over value cells, so a key with very many
    holders is not sorted in one task.
    """
    counts = balances.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running(counts, keys, [F.col("__v")], [Running("__hi", "sum", F.col("__c"))])
    c, start = F.col("__c").cast("double"), (F.col("__hi") - F.col("__c")).cast("double")
    ranks = c * start + c * (c + 1) / 2
    agg = ranked.groupBy(*keys).agg(F.sum("__c").alias("n"), F.sum(F.col("__v") * c).alias("total"), F.sum(F.col("__v") * ranks).alias("w"))
    g = 2 * safe_div(F.col("w"), F.col("n") * F.col("total")) - (F.col("n") + 1.0) / F.col("n")
    return agg.select(*keys, "n", "total", F.when(F.col("total") > 0, g).alias("gini"))


def top_shares(balances: DataFrame, keys: list[str], value: str, ks: tuple = (1, 5, 10)) -> DataFrame:
    """Sum of the k largest balances per key; each task keeps only its own top few before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    top = balances.select(*keys, value).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(ks))
    return top.groupBy(*keys).agg(*[sum_if(F.col("__r") <= k, F.col(value)).alias(f"top{k}") for k in ks])


def concentration(balances: DataFrame, candidates: DataFrame) -> DataFrame:
    """event_* ownership features per mint over positive balances. ``candidates``: mint, creator, supply."""
    held = balances.where(F.col("balance") > 0)
    tops = top_shares(held, ["mint"], "balance")
    spread = gini(held, ["mint"], "balance")
    creators = candidates.select("mint", F.col("creator").alias("user_wallet")).where(F.col("user_wallet").isNotNull())
    dev = held.join(creators, ["mint", "user_wallet"]).select("mint", F.col("balance").alias("dev"))
    pct = lambda c: 100 * F.col(c) / F.col("supply")
    return (spread.join(tops, "mint").join(dev, "mint", "left").join(candidates.select("mint", "supply"), "mint").select(
        "mint", F.col("n").alias("event_holder_count"), pct("top1").alias("event_top1_pct"), pct("top5").alias("event_top5_pct"),
        pct("top10").alias("event_top10_pct"), F.coalesce(pct("dev"), F.lit(0.0)).alias("event_dev_pct"), F.col("gini").alias("event_gini")))


def enrich_ownership(candidates: DataFrame, tokens: DataFrame, tape: DataFrame, signal_us: str = "signal_us", strict: bool = False) -> DataFrame:
    """Candidates with event ownership features; needs at least two holders and a Gini."""
    cand = with_supply(candidates, tokens)
    own = concentration(balances_at(cand, tape, signal_us, strict=strict), cand)
    return cand.join(own, "mint").where((F.col("event_holder_count") >= 2) & F.col("event_gini").isNotNull())


def _truncated_pct(amount: Column, supply: Column) -> Column:
    """Percent of supply cut (not rounded) to five decimals."""
    return F.call_function("div", amount.cast("decimal(20,0)") * F.lit(10_000_000).cast("decimal(10,0)"), supply).cast("double") / 100_000


def snapshot_concentration(balances: DataFrame) -> DataFrame:
    """Concentration per mint from a balance table: curve accounts leave the shares but stay in the holder count.

    ``balances``: mint, address, amount, mayhem_mode, is_curve_account, is_creator_account.
    """
    held = balances.where(F.col("amount") > 0)
    human = held.where(~F.col("is_curve_account"))
    supply = F.when(F.col("mayhem_mode"), F.lit(2_000_000_000_000_000)).otherwise(F.lit(1_000_000_000_000_000)).cast("long")
    base = held.groupBy("mint").agg(
        F.count(F.lit(1)).alias("initial_holder_count"), F.max("mayhem_mode").alias("mayhem_mode"),
        F.sum(F.when(F.col("is_creator_account"), F.col("amount")).otherwise(0)).alias("creator_amount"),
        F.max("is_curve_account").alias("curve_account_excluded"))
    out = base.join(top_shares(human, ["mint"], "amount"), "mint", "left").join(
        gini(human, ["mint"], "amount").withColumnRenamed("n", "human_accounts"), "mint", "left").withColumn("supply", supply)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "mint", "initial_holder_count", F.coalesce("human_accounts", F.lit(0)).alias("human_accounts"), "curve_account_excluded",
        *[_truncated_pct(z(f"top{k}"), F.col("supply")).alias(f"initial_top{k}_pct_corrected") for k in (1, 5, 10)],
        _truncated_pct(z("creator_amount"), F.col("supply")).alias("dev_buy_pct_corrected"),
        F.when(F.col("human_accounts") >= 2, F.col("gini")).alias("initial_gini"))
