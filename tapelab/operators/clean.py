"""Tape window, cleaning rules, rejection accounting, manifests, token dimension, history filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tapelab.functions.exprs import col, count_if, safe_div
from tapelab.operators.asof import salted_join

# Fixed value: the pseudo-wallet of the system program on the public tape.
PUBLIC_SYSTEM_WALLET = "BwWK17cbHxwWBKZkUYvzxLcNQ1YVyaFezduWbtm2de6s"


@dataclass(frozen=True)
class CleanRules:
    system_wallet: str = PUBLIC_SYSTEM_WALLET
    ratio_low: float = 0.01
    ratio_high: float = 100.0
    curve_low: float = 0.0
    curve_high: float = 100.0

    def checks(self) -> list[tuple[str, Column]]:
        """(name, passes) in the order they are reported. A NULL verdict is a failure."""
        ratio = safe_div(F.col("sol_amount"), F.col("token_amount") * F.col("price_sol"))
        return [
            ("system_wallet", F.col("user_wallet") != self.system_wallet),
            ("missing_amount", F.col("sol_amount").isNotNull() & F.col("price_sol").isNotNull()
             & F.col("token_amount").isNotNull()),
            ("not_positive", (F.col("sol_amount") > 0) & (F.col("token_amount") > 0) & (F.col("price_sol") > 0)),
            ("inconsistent_ratio", ratio.between(self.ratio_low, self.ratio_high)),
            ("curve_out_of_range", F.col("curve_pct_depleted").between(self.curve_low, self.curve_high)),
            ("before_launch", F.col("seconds_since_launch") >= 0),
        ]


def last_window(tape: DataFrame, days: int = 7, ts: str = "event_time") -> DataFrame:
    """Rows of the last ``days`` days up to the latest event, both ends inclusive.

    The end is a one-value scalar subquery, answered from parquet statistics or a partial max.
    """
    end = tape.agg(F.max(ts)).scalar()
    return tape.where(F.col(ts) >= end - F.make_dt_interval(days=F.lit(days)))


def clean_tape(tape: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    for _, ok in rules.checks():
        tape = tape.where(ok)
    return tape


def rejection_report(tape: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Rows per first failing rule, kept rows included, in one pass."""
    verdict = F.lit("kept")
    for name, ok in reversed(rules.checks()):
        verdict = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(verdict)
    return tape.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def tape_manifest(tape: DataFrame) -> DataFrame:
    """Counts and bounds of a tape.

    Distinct mints and wallets are separate two-step counts, so rows are never expanded per distinct column.
    """
    base = tape.agg(
        F.count(F.lit(1)).alias("trades"),
        F.min("event_time").alias("observed_start"),
        F.max("event_time").alias("observed_end"),
        count_if(F.col("is_buy")).alias("buys"),
        count_if(~F.col("is_buy")).alias("sells"),
    )
    mints = tape.select("mint").distinct().agg(F.count("mint")).scalar()
    wallets = tape.select("user_wallet").distinct().agg(F.count("user_wallet")).scalar()
    return base.withColumns({"mints": mints, "wallets": wallets})


def bars_manifest(bars: DataFrame) -> DataFrame:
    base = bars.agg(F.count(F.lit(1)).alias("bars"), F.min("bucket").alias("first_bucket"),
                    F.max("bucket").alias("last_bucket"))
    return base.withColumn("mints", bars.select("mint").distinct().agg(F.count("mint")).scalar())


def token_dim(tokens: DataFrame, tape: DataFrame) -> DataFrame:
    """Token attributes for mints on the tape, without rows whose top-10 share is suspect."""
    kept = tokens.where(~F.coalesce(F.col("top10_pct_suspect"), F.lit(False))).drop("top10_pct_suspect")
    return kept.join(tape.select("mint").distinct(), "mint", "left_semi")


def wallet_history(events: DataFrame, wallets: DataFrame, start: Column, end: Column, ts: str | Column,
                   user: str = "user") -> DataFrame:
    """Events of the given wallets with start <= time <= end. A busy wallet's events spread over salts."""
    t = col(ts)
    names = wallets.select(F.col("wallet").alias(user)).distinct()
    return salted_join(events.where((t >= start) & (t <= end)), names, [user], events.columns, how="left_semi")


def unprocessed(events: DataFrame, done: DataFrame, key: str = "signature") -> DataFrame:
    """Events whose key has not been processed yet."""
    return events.join(done.select(key).distinct(), key, "left_anti")
