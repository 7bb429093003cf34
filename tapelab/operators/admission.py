"""Capacity-limited accounts: admit trades in entry order while slots and cash allow.

Admission depends on everything admitted before it, but the state handed from one moment to the next is tiny: the
open exits and the realised PnL. Each account is cut into bounded chunks in entry order. All chunks run in parallel
from a guessed state; a chunk reports its end state and the range of starting PnL for which its decisions stay the
same. Chunks whose guess was wrong run again from the state their predecessor ended in, until nothing changes. The
result equals the one-by-one replay, and no account is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tapelab.functions.exprs import count_if
from tapelab.operators.scan import arrival_rank, max_drawdown
from tapelab.session import cut_lineage

CHUNK_ROWS = 50_000


def _walk(rows: pd.DataFrame, open_exits: list, open_pnls: list, start: float, capital: float, max_open: int, required: float):
    """Replay one chunk. Returns accepted flags, open positions at the end, PnL released, and the [lo, hi) range of
    starting PnL that leaves every decision as it is."""
    slots = sorted(zip(open_exits, open_pnls))
    gained, lo, hi = 0.0, -np.inf, np.inf
    accepted = np.zeros(len(rows), dtype=bool)
    for i, (entry, leave, pnl) in enumerate(zip(rows["entry_us"].to_numpy(), rows["exit_us"].to_numpy(), rows["pnl_sol"].to_numpy())):
        while slots and slots[0][0] <= entry:
            gained += slots.pop(0)[1]
        if len(slots) >= max_open:
            continue
        need = required * (len(slots) + 1) - capital - gained
        if start >= need:
            lo = max(lo, need)
            accepted[i] = True
            slots = sorted([*slots, (leave, pnl)])
        else:
            hi = min(hi, need)
    return accepted, slots, gained, lo, hi


def admit(trades: DataFrame, accounts: list[str], capital: float = 3.0, max_open: int = 3, required: float = 0.5032,
          chunk_rows: int = CHUNK_ROWS, extra: list[str] | None = None) -> DataFrame:
    """``trades`` with an ``accepted`` flag. Needs account columns, mint, entry_us, exit_us, pnl_sol.

    Positions whose exit is at or before an entry are released first. Ties in entry time go by mint.
    """
    keep = [*accounts, "mint", "entry_us", "exit_us", "pnl_sol", *(extra or [])]
    # Arrival ranks come from equal cells, so chunks are equal in size however trades bunch up in time or by account.
    ranked = arrival_rank(trades.select(*keep), accounts, [F.col("entry_us"), F.col("mint")], "__n")
    chunked = ranked.withColumn("__chunk", F.floor((F.col("__n") - 1) / chunk_rows).cast("long")).drop("__n")
    chunked = cut_lineage(chunked)
    keys = [*accounts, "__chunk"]
    key_fields = [f for f in chunked.schema.fields if f.name in keys]
    slots_type = T.ArrayType(T.StructType([T.StructField("exit_us", T.LongType()), T.StructField("pnl", T.DoubleType())]))
    summary = T.StructType([*key_fields, T.StructField("slots_out", slots_type), T.StructField("gained", T.DoubleType()),
                            T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    flagged = T.StructType([*[f for f in chunked.schema.fields if f.name != "__chunk"], T.StructField("accepted", T.BooleanType())])

    def run(rows: pd.DataFrame, state: pd.DataFrame):
        rows = rows.sort_values(["entry_us", "mint"], kind="mergesort")
        slots, start = state["slots_in"].iloc[0], float(state["start"].iloc[0])
        return rows, _walk(rows, [s["exit_us"] for s in slots], [s["pnl"] for s in slots], start, capital, max_open, required)

    def summarise(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or state.empty:
            return pd.DataFrame({f.name: [] for f in summary.fields})
        _, (_, slots, gained, lo, hi) = run(rows, state)
        head = {k: [rows[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "slots_out": [[{"exit_us": int(e), "pnl": float(p)} for e, p in slots]], "gained": [gained],
                             "lo": [lo], "hi": [hi]})

    def flag(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or state.empty:
            return pd.DataFrame({f.name: [] for f in flagged.fields})
        rows, (accepted, *_) = run(rows, state)
        return rows.assign(accepted=accepted)[[f.name for f in flagged.fields]]

    grouped = chunked.groupBy(*keys)
    none = F.array().cast(slots_type)
    guess = chunked.select(*keys).distinct().select(*keys, none.alias("slots_in"), F.lit(float("inf")).alias("start"))
    results = cut_lineage(grouped.cogroup(guess.groupBy(*keys)).applyInPandas(summarise, summary).join(guess, keys))
    by_time = Window.partitionBy(*accounts).orderBy("__chunk")
    while True:
        # What each chunk should have started from, given how its predecessors ended.
        due = results.withColumns({
            "slots_due": F.coalesce(F.lag("slots_out").over(by_time), none),
            "start_due": F.coalesce(F.sum("gained").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
        stale = (F.col("slots_in") != F.col("slots_due")) | ~((F.col("lo") <= F.col("start_due")) & (F.col("start_due") < F.col("hi")))
        due = cut_lineage(due.withColumn("stale", stale))
        if due.where("stale").isEmpty():
            break
        redo = due.where("stale").select(*keys, F.col("slots_due").alias("slots_in"), F.col("start_due").alias("start"))
        again = (chunked.join(redo.select(*keys), keys, "left_semi").groupBy(*keys).cogroup(redo.groupBy(*keys))
                 .applyInPandas(summarise, summary).join(redo, keys))
        results = cut_lineage(due.where("NOT stale").select(*results.columns).unionByName(again.select(*results.columns)))
    final = due.select(*keys, F.col("slots_due").alias("slots_in"), F.col("start_due").alias("start"))
    return grouped.cogroup(final.groupBy(*keys)).applyInPandas(flag, flagged)


def account_report(admitted: DataFrame, accounts: list[str], capital: float = 3.0) -> DataFrame:
    """Per account: candidates, accepted trades, PnL, bankroll, win rate, drawdown, largest share, exit counts.

    ``admitted``: account columns, mint, entry_us, exit_us, pnl_sol, exit_reason, accepted.
    """
    ok, pnl = F.col("accepted"), F.col("pnl_sol")
    reason = lambda name: count_if(ok & (F.col("exit_reason") == name))
    base = admitted.groupBy(*accounts).agg(
        F.count(F.lit(1)).alias("replayable"), count_if(ok).alias("accepted_trades"),
        F.coalesce(F.sum(F.when(ok, pnl)), F.lit(0.0)).alias("pnl_sol"), count_if(ok & (pnl > 0)).alias("wins"),
        F.coalesce(F.max(F.when(ok, pnl)), F.lit(0.0)).alias("largest"),
        reason("TAKE_PROFIT").alias("take_profits"), reason("STOP_LOSS").alias("stop_losses"), reason("TIMEOUT").alias("timeouts"))
    dd = max_drawdown(admitted.where(ok), accounts, [F.col("exit_us"), F.col("entry_us"), F.col("mint")], pnl, "dd")
    return base.join(dd, accounts, "left").select(
        *accounts, "replayable", "accepted_trades", "pnl_sol", (F.lit(capital) + F.col("pnl_sol")).alias("ending_bankroll_sol"),
        (F.col("wins") / F.nullif(F.col("accepted_trades"), F.lit(0))).alias("win_rate"),
        F.coalesce("dd", F.lit(0.0)).alias("max_drawdown_sol"),
        F.when(F.col("pnl_sol") > 0, F.col("largest") / F.nullif(F.col("pnl_sol"), F.lit(0.0))).alias("largest_profit_share"),
        "take_profits", "stop_losses", "timeouts")
