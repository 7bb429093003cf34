"""Ledger reconciliation and account reports, recomputed from append-only rows; no mutable state document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapelab.functions.exprs import count_if, floor_div


def first_decisions(decisions: DataFrame) -> DataFrame:
    """First decision per pool by (at, decision_seq), with the number of later duplicates."""
    rest = [c for c in decisions.columns if c not in ("pool", "at", "decision_seq")]
    return (decisions.groupBy("pool").agg(F.min(F.struct("at", "decision_seq", *rest)).alias("f"), (F.count(F.lit(1)) - 1).alias("duplicates"))
            .select("pool", "f.*", "duplicates"))


def split_exits(exits: DataFrame, firsts: DataFrame, entries: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Exits with ``valid``: the pool's first decision qualified, the entry exists, and it was not invalidated."""
    q = firsts.where(F.col("decision") == "QUALIFY").select("pool", F.lit(True).alias("__q"))
    e = entries.select("id").distinct().withColumn("__e", F.lit(True))
    i = invalidated.select("id").distinct().withColumn("__i", F.lit(True))
    out = exits.join(q, "pool", "left").join(e, "id", "left").join(i, "id", "left")
    return out.withColumn("valid", F.col("__q").isNotNull() & F.col("__e").isNotNull() & F.col("__i").isNull()).drop("__q", "__e", "__i")


def corrections(split: DataFrame, at: Column) -> DataFrame:
    """Correction rows to append for exits that do not count."""
    return split.where(~F.col("valid")).select(
        at.alias("at"), F.lit("EXCLUDED_EXIT").alias("type"), "id", "pool", "pnl_sol", F.lit("DUPLICATE_MIGRATION_REDECISION").alias("reason"))


def rebuild_account(split: DataFrame, firsts: DataFrame, entries: DataFrame, invalidated: DataFrame, skips: DataFrame, capital: float) -> DataFrame:
    """One row: the account as its ledgers say it is."""
    pnl = F.col("pnl_sol")
    done = split.where("valid").agg(F.coalesce(F.sum(pnl), F.lit(0.0)).alias("realized_pnl_sol"), F.count(F.lit(1)).alias("completed_trades"),
                                    count_if(pnl > 0).alias("wins"), count_if(pnl <= 0).alias("losses"))
    dec = firsts.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("decision") == "SKIP").alias("s"), F.sum("duplicates").alias("d"))
    void = invalidated.select("id").union(split.where("NOT valid").select("id")).distinct()
    count = lambda df, c: df.agg(F.count(F.lit(1)).alias(c)).scalar()
    return done.withColumns({
        "available_bankroll_sol": F.lit(capital) + F.col("realized_pnl_sol"), "decisions": dec.select("n").scalar(),
        "duplicate_decisions": F.coalesce(dec.select("d").scalar(), F.lit(0)), "entered": count(entries.select("pool").distinct(), "e"),
        "skipped": dec.select("s").scalar() + count(skips, "k"), "invalidated_trades": count(void, "v")})


def open_positions(entries: DataFrame, exits: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Entries that were neither closed nor invalidated."""
    return entries.join(exits.select("id").union(invalidated.select("id")).distinct(), "id", "left_anti")


def require_closed(entries: DataFrame, exits: DataFrame, invalidated: DataFrame) -> None:
    """Stops a reconciliation while positions are open."""
    if not open_positions(entries, exits, invalidated).isEmpty():
        raise RuntimeError("refusing to reconcile while positions are open")


def shadow_report(trades: DataFrame, minimum: int = 50, target: int = 100) -> DataFrame:
    """Per size cohort: results and sample progress. ``trades``: size_sol, pnl_sol (NULL while open), invalidated."""
    closed = F.col("pnl_sol").isNotNull() & ~F.col("invalidated")
    pnl = F.when(closed, F.col("pnl_sol"))
    rep = trades.groupBy("size_sol").agg(
        count_if(closed).alias("completed_trades"), count_if(~closed & ~F.col("invalidated")).alias("open_positions"),
        count_if(pnl > 0).alias("wins"), count_if(pnl <= 0).alias("losses"), F.coalesce(F.sum(pnl), F.lit(0.0)).alias("realized_pnl_sol"),
        F.avg(pnl).alias("average_pnl_sol"), count_if(F.col("invalidated")).alias("invalidated_trades"))
    done = F.col("completed_trades")
    rep = rep.withColumns({
        "win_rate_pct": 100 * F.col("wins") / F.nullif(done, F.lit(0)),
        "minimum_progress_pct": F.least(F.lit(100.0), 100 * done / minimum), "target_progress_pct": F.least(F.lit(100.0), 100 * done / target)})
    least = rep.agg(F.min("completed_trades")).scalar()
    return rep.withColumn("status", F.when(least >= target, "TARGET_REACHED").when(least >= minimum, "MINIMUM_REACHED").otherwise("COLLECTING"))


def latency_report(trades: DataFrame, landed: DataFrame, capital: float) -> DataFrame:
    """Per account: target delay, bankroll, results, entered and skipped signals."""
    done = trades.groupBy("account").agg(
        F.count(F.lit(1)).alias("completed_trades"), F.sum("pnl_sol").alias("realized_pnl_sol"), count_if(F.col("pnl_sol") > 0).alias("wins"),
        count_if(F.col("pnl_sol") <= 0).alias("losses"))
    seen = landed.groupBy("account", F.col("entry_delay_ms").alias("target_delay_ms")).agg(
        F.count(F.lit(1)).alias("matched_signals"), count_if(F.col("status") == "FILLED").alias("entered"),
        count_if(F.col("status") != "FILLED").alias("skipped"))
    out = seen.join(done, "account", "left").fillna({"completed_trades": 0, "realized_pnl_sol": 0.0, "wins": 0, "losses": 0})
    return out.withColumns({"bankroll_sol": F.lit(capital) + F.col("realized_pnl_sol"), "open_positions": F.col("entered") - F.col("completed_trades")})


def account_summary(trades: DataFrame, capital: float, t_ms: str = "exit_ms") -> DataFrame:
    """Per account and UTC day: trades, PnL and win rate of that day; ``bankroll_sol`` after the day."""
    day = floor_div(F.col(t_ms), 86_400_000)
    daily = trades.groupBy("account", day.alias("d")).agg(
        F.count(F.lit(1)).alias("completed_trades"), F.sum("pnl_sol").alias("realized_pnl_sol"), count_if(F.col("pnl_sol") > 0).alias("wins"))
    w = Window.partitionBy("account").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    return daily.select("account", F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")).cast("string").alias("day"), "completed_trades",
                        "realized_pnl_sol", (100 * F.col("wins") / F.col("completed_trades")).alias("win_rate_pct"),
                        (F.lit(capital) + F.sum("realized_pnl_sol").over(w)).alias("bankroll_sol"))


def skip_summary(replays: DataFrame) -> DataFrame:
    """Per account: how many skipped signals could be replayed and what they would have made. ``replays``: replay_skipped output."""
    applicable = replays.where(F.col("status") != "ACTUALLY_ENTERED")
    closed = F.col("status") == "CLOSED"
    return applicable.groupBy("account").agg(
        F.count(F.lit(1)).alias("skipped_candidates"), count_if(closed).alias("closed"), count_if(closed & (F.col("pnl_sol") > 0)).alias("wins"),
        count_if(closed & (F.col("pnl_sol") <= 0)).alias("losses"), count_if(~closed).alias("not_closed"),
        F.coalesce(F.sum(F.when(closed, F.round("pnl_sol", 6))), F.lit(0.0)).alias("total_pnl_sol"))


def skip_statuses(replays: DataFrame) -> DataFrame:
    """Histogram of replay statuses per account."""
    return replays.where(F.col("status") != "ACTUALLY_ENTERED").groupBy("account", "status").agg(F.count(F.lit(1)).alias("n"))


def skip_winners(replays: DataFrame, decisions: DataFrame, migrations: DataFrame, skips: DataFrame) -> DataFrame:
    """Skipped signals that would have won, with why and where they were skipped.

    ``skips``: pool, account, at, reason; the latest row per (pool, account) counts, else the selector's reasons.
    """
    last = skips.groupBy("pool", "account").agg(F.max_by("reason", "at").alias("landing_reason"))
    won = replays.where((F.col("status") == "CLOSED") & (F.col("pnl_sol") > 0))
    out = (won.join(decisions.select("pool", "reasons"), "pool").join(last, ["pool", "account"], "left")
           .join(migrations.select("pool", F.col("symbol").alias("known_symbol")), "pool", "left"))
    return out.withColumns({
        "symbol": F.coalesce("known_symbol", F.substring("pool", 1, 8)),
        "skip_stage": F.when(F.col("landing_reason").isNotNull(), "LANDING_GUARD").otherwise("SELECTOR"),
        "skip_reason": F.coalesce("landing_reason", F.array_join("reasons", "; "), F.lit("unknown"))})


def case_studies(trades: DataFrame, migrations: DataFrame) -> DataFrame:
    """Lifecycle stamps and latency steps per closed trade, as a table.

    ``trades``: delayed_exits output with submitted_ms.
    """
    m = migrations.select("pool", "symbol", "blockTime", "migrationLogReceivedAtMs", "migrationResolvedAtMs", "migrationResolutionMs")
    block = F.col("blockTime") * 1000
    return trades.join(m, "pool").select(
        "pool", "account", "symbol", block.alias("migration_block_ms"), F.col("migrationLogReceivedAtMs").alias("log_received_ms"),
        F.col("migrationResolvedAtMs").alias("resolved_ms"), "submitted_ms", "entry_ms", "trigger_ms", F.col("exit_target_ms").alias("exit_ms"),
        (F.col("migrationLogReceivedAtMs") - block).alias("block_to_log_ms"), F.col("migrationResolutionMs").alias("log_to_resolved_ms"),
        (F.col("submitted_ms") - F.col("migrationResolvedAtMs")).alias("resolved_to_signal_ms"),
        (F.col("entry_ms") - F.col("submitted_ms")).alias("signal_to_entry_ms"), (F.col("exit_target_ms") - F.col("trigger_ms")).alias("trigger_to_exit_ms"),
        ((F.col("exit_target_ms") - F.col("entry_ms")) / 1000.0).alias("hold_seconds"), "trigger_reason", "pnl_sol", "return_pct")
