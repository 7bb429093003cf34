"""Event-level replays: latency stress, delayed entries and exits, skipped signals, curve fills, competition, size sweep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapelab.functions import bar_amm as B, curve_amm as K, pool_amm as P
from tapelab.functions.exprs import count_if, literal_rows
from tapelab.functions.gates import DumpGuard
from tapelab.operators.admission import admit
from tapelab.operators.asof import asof_backward, asof_forward, interval_join, salted_join
from tapelab.operators.outcomes import STOP_CURVE
from tapelab.operators.pools import flow_totals, running_drawdown
from tapelab.operators.scan import Cells, Running, equal_cells, running
from tapelab.session import cut_lineage

# Latency, fee and queue scenarios of the stress replay.
SCENARIOS = [
    {"scenario": "optimistic-170", "latency_ms": 170, "fee_rate": 0.0125, "tx_cost": 0.0032, "ahead_sol": 0.0},
    {"scenario": "base-670", "latency_ms": 670, "fee_rate": 0.0125, "tx_cost": 0.0032, "ahead_sol": 0.0},
    {"scenario": "safe-1170", "latency_ms": 1170, "fee_rate": 0.0125, "tx_cost": 0.0032, "ahead_sol": 0.0},
    {"scenario": "fee-stress-670", "latency_ms": 670, "fee_rate": 0.025, "tx_cost": 0.0064, "ahead_sol": 0.0},
    {"scenario": "hostile-1170", "latency_ms": 1170, "fee_rate": 0.025, "tx_cost": 0.0064, "ahead_sol": 1.0},
    {"scenario": "crowded-3170", "latency_ms": 3170, "fee_rate": 0.025, "tx_cost": 0.0064, "ahead_sol": 2.0},
    {"scenario": "broken-7170", "latency_ms": 7170, "fee_rate": 0.025, "tx_cost": 0.0064, "ahead_sol": 2.0},
]


def stress_replay(signals: DataFrame, tape: DataFrame, scenarios: list[dict] = SCENARIOS, size: float = 0.5, tp: float = 0.40,
                  sl: float = -0.25, hold_us: int = 20_000_000, close_us: int = 1_000_000, latency_unit_us: int = 1_000,
                  salts: int = 16) -> DataFrame:
    """Outcome per (signal, scenario) on raw events.

    Entry is the first event at or after bar close plus latency. ``signals``: mint, signal_us (one per mint).
    Each event meets at most one row per scenario; hot mints spread over salts, and exits are partial minima.
    """
    ev = tape.select("mint", F.unix_micros("event_time").alias("t"), "id", "curve_pct_depleted", "v_sol_bonding_curve",
                     "v_tokens_bonding_curve", "market_cap_sol")
    ev = salted_join(ev, signals.select("mint").distinct(), ["mint"], ["id"], salts, "left_semi")
    cells = equal_cells(ev, ["mint"], F.col("t"))
    s = F.explode(literal_rows(scenarios))
    wanted = signals.select("mint", "signal_us", s.alias("s")).select("mint", "signal_us", "s.*")
    target = F.col("signal_us") + close_us + F.col("latency_ms") * latency_unit_us
    at = asof_forward(wanted, ev, ["mint"], target, F.col("t"), [F.col("id")], "e", cells=cells)
    tokens = B.entry_tokens(F.col("e.v_sol_bonding_curve"), F.col("e.v_tokens_bonding_curve"), size, F.col("fee_rate"), F.col("ahead_sol"))
    ent = at.select("mint", "signal_us", "scenario", "fee_rate", "tx_cost", F.col("e.t").alias("entry_us"), F.col("e.id").alias("entry_id"),
                    F.col("e.market_cap_sol").alias("entry_mc"), F.col("e.curve_pct_depleted").alias("ec"), tokens.alias("tokens"))
    ent = ent.where(F.col("entry_us").isNotNull() & (F.col("ec") < STOP_CURVE) & F.col("tokens").isNotNull()).drop("ec")
    closing = ev.where(F.col("curve_pct_depleted") >= STOP_CURVE).select("mint", "t", "id")
    ent = asof_forward(ent, closing, ["mint"], F.col("entry_us"), F.col("t"), [F.col("id")], "stop", strict=True,
                       left_tie=[F.col("entry_id")], cells=cells)
    here = ["t", "id", "v_sol_bonding_curve", "v_tokens_bonding_curve", "market_cap_sol"]
    # The first event at or after the end of the hold closes whatever is still open.
    ent = asof_forward(ent, ev.select("mint", *here), ["mint"], F.col("entry_us") + hold_us, F.col("t"), [F.col("id")], "close", cells=cells)
    # One row per (mint, scenario), read by the walk and the join below: written once instead of repeating the as-of joins.
    ent = cut_lineage(ent.withColumns({"stop_t": F.col("stop.t"), "stop_id": F.col("stop.id")}).drop("stop"))

    who = ["mint", "scenario", "signal_us"]
    pos, first = F.struct("t", "id"), F.struct(F.col("entry_us").alias("t"), F.col("entry_id").alias("id"))
    stop = F.struct(F.col("stop_t").alias("t"), F.col("stop_id").alias("id"))
    pnl = B.liquidation_pnl(F.col("v_sol_bonding_curve"), F.col("v_tokens_bonding_curve"), F.col("tokens"), size, F.col("fee_rate"), F.col("tx_cost"))
    terms = [*who, "entry_us", "entry_id", "tokens", "fee_rate", "tx_cost", "stop_t", "stop_id"]

    def walk(rows: DataFrame) -> DataFrame:
        """Exit, peak and trough per position from its events in order."""
        open_rows = rows.where((pos > first) & (F.col("stop_t").isNull() | (pos < stop))).withColumn("pnl", pnl).where(F.col("pnl").isNotNull())
        upto = Window.partitionBy(*who).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = open_rows.withColumns({"ret": F.col("pnl") / (F.lit(size) + F.col("tx_cost")), "peak": F.max("pnl").over(upto), "trough": F.min("pnl").over(upto)})
        fired = (F.col("ret") >= tp) | (F.col("ret") <= sl) | (F.col("t") - F.col("entry_us") >= hold_us)
        row = F.struct("t", "id", "pnl", "ret", "market_cap_sol", "peak", "trough")
        return seen.groupBy(*who).agg(F.min(F.when(fired, row)).alias("hit"), F.max(row).alias("last"))

    # A path is the events inside the hold, which meet their position through time cells, and the closing event.
    inside = interval_join(ent.select(*terms), ev.select("mint", *here), ["mint"], F.col("entry_us"), F.col("entry_us") + (hold_us - 1), F.col("t"))
    closes = ent.where(F.col("close").isNotNull()).select(*terms, *[F.col(f"close.{c}").alias(c) for c in here])
    exits = walk(inside.select(*terms, *here).unionByName(closes))
    # A closing event that cannot be quoted closes nothing: such positions (normally none) walk on to the end of their token.
    shut = closes.where((F.col("stop_t").isNull() | (pos < stop)) & pnl.isNull()).select(*who)
    odd = ent.select(*terms).join(shut, who, "left_semi")
    late = walk(salted_join(ev.select("mint", *here), odd, ["mint"], ["id"], salts).select(*terms, *here))
    both = exits.join(late.withColumnsRenamed({"hit": "late_hit", "last": "late_last"}), who, "left").select(
        *who, F.coalesce("hit", "late_hit", "late_last", "last").alias("x"))
    out = ent.join(both, who)
    reason = F.when(F.col("x.ret") >= tp, "TAKE_PROFIT").when(F.col("x.ret") <= sl, "STOP_LOSS").otherwise("TIMEOUT")
    return out.select(
        *who, "entry_us", F.col("x.t").alias("exit_us"), F.col("x.pnl").alias("pnl_sol"), F.col("x.peak").alias("peak_pnl_sol"),
        F.col("x.trough").alias("trough_pnl_sol"), reason.alias("exit_reason"), F.col("entry_mc").alias("entry_market_cap_sol"),
        F.col("x.market_cap_sol").alias("exit_market_cap_sol"))


# ---- delayed entries and exits on event streams ----------------------------------------------------------------

@dataclass(frozen=True)
class ExitPlan:
    """Exit rule on the marked return, in the unit of the return column."""

    take_profit: float
    stop_loss: float
    timeout_ms: int


def first_triggers(positions: DataFrame, events: DataFrame, keys: list[str], ids: list[str], ret: Column, plan: ExitPlan) -> DataFrame:
    """Positions with trigger_ms, trigger_seq, trigger_ret, trigger_reason and the best return up to the trigger.

    ``positions``: ids, keys, entry_ms, entry_seq, entry_ret. ``ret`` is the marked return of a position on an event row.
    A position with no price trigger times out exactly at entry + timeout (trigger_ret NULL).
    """
    slim = events.withColumnsRenamed({"receivedAtMs": "ev_ms", "receivedSequence": "ev_seq"})
    after = (F.col("ev_ms") > F.col("entry_ms")) | ((F.col("ev_ms") == F.col("entry_ms")) & (F.col("ev_seq") > F.col("entry_seq")))
    marked = (interval_join(positions, slim, keys, F.col("entry_ms"), F.col("entry_ms") + plan.timeout_ms, F.col("ev_ms"))
              .where(after).withColumn("ret", ret).where(F.col("ret").isNotNull()).select(*ids, "ev_ms", "ev_seq", "ret"))
    hit = (F.col("ret") >= plan.take_profit) | (F.col("ret") <= plan.stop_loss)
    # The best return needs the trigger's position, so it is a second aggregate over the same rows.
    trig = marked.groupBy(*ids).agg(F.min(F.when(hit, F.struct("ev_ms", "ev_seq", "ret"))).alias("x"))
    pos = F.struct("ev_ms", "ev_seq")
    upto = F.col("x").isNull() | (pos <= F.struct(F.col("x.ev_ms"), F.col("x.ev_seq")))
    best = salted_join(marked, trig, ids, ["ev_ms", "ev_seq"]).where(upto).groupBy(*ids).agg(F.max("ret").alias("path_best"))
    out = positions.join(trig, ids, "left").join(best, ids, "left")
    return out.withColumns({
        "trigger_ms": F.coalesce(F.col("x.ev_ms"), F.col("entry_ms") + plan.timeout_ms), "trigger_seq": F.col("x.ev_seq"),
        "trigger_ret": F.col("x.ret"),
        "trigger_reason": F.when(F.col("x.ret") >= plan.take_profit, "TAKE_PROFIT").when(F.col("x.ret") <= plan.stop_loss, "STOP_LOSS")
        .otherwise("TIMEOUT"),
        "max_ret": F.greatest(F.col("entry_ret"), F.col("path_best"))}).drop("x", "path_best")


def swap_states(swaps: DataFrame) -> DataFrame:
    """Slim swap rows: keys, time, sequence and the pool state they leave behind."""
    return swaps.select("pool", "receivedAtMs", "receivedSequence", P.pool_after().as_struct().alias("state"))


def _by_receipt(cells: Cells | None) -> dict:
    return dict(keys=["pool"], right_time=F.col("receivedAtMs"), right_tie=[F.col("receivedSequence")], cells=cells)


def receipt_cells(swaps: DataFrame) -> Cells:
    """Cells of the swaps of each pool; found once, they serve all joins against these swaps."""
    return equal_cells(swaps, ["pool"], F.col("receivedAtMs"))


def state_at(left: DataFrame, swaps: DataFrame, at: Column, payload: str, cells: Cells | None = None) -> DataFrame:
    """Latest pool state at or before an instant; callers coalesce their own fallback."""
    return asof_backward(left, swap_states(swaps), left_time=at, payload=payload, **_by_receipt(cells))


def enter_at(signals: DataFrame, swaps: DataFrame, target: Column, cells: Cells | None = None) -> DataFrame:
    """First swap at or after the target per signal, as ``e`` (NULL when none), with ``target_ms``."""
    return asof_forward(signals.withColumn("target_ms", target), swap_states(swaps), left_time=F.col("target_ms"), payload="e",
                        **_by_receipt(cells))


def with_entry_quote(entered: DataFrame, size: Column, tx_cost: float) -> DataFrame:
    """Entry quote and entry mark on the landing state ``e``; tokens_raw is NULL when it cannot be quoted."""
    pool = P.Pool.from_struct(F.col("e.state"))
    out = entered.withColumn("buy", P.quote_buy(pool, size))
    return out.withColumns({
        "entry_ms": F.col("e.receivedAtMs"), "entry_seq": F.col("e.receivedSequence"), "entry_state": F.col("e.state"),
        "tokens_raw": F.col("buy.tokens_raw"), "entry_mcap_sol": P.fill_mcap(F.col("buy.spend_sol"), F.col("buy.tokens_raw"), pool.supply),
        "entry_spot_mcap_sol": P.spot_mcap(pool),
        "entry_ret": P.mark(pool, F.col("buy.tokens_raw"), size, tx_cost)["return_pct"]}).drop("buy", "e")


def delayed_exits(positions: DataFrame, swaps: DataFrame, ids: list[str], plan: ExitPlan, delay: Column, size: Column, tx_cost: float,
                  cells: Cells | None = None) -> DataFrame:
    """Trigger on the mark, fill on the latest state at trigger + delay."""
    events = swap_states(swaps)
    ret = P.mark(P.Pool.from_struct(F.col("state")), F.col("tokens_raw"), size, tx_cost)["return_pct"]
    out = first_triggers(positions, events, ["pool"], ids, ret, plan)
    out = out.withColumn("exit_target_ms", F.col("trigger_ms") + delay)
    out = state_at(out, swaps, F.col("exit_target_ms"), "x", cells or receipt_cells(swaps))
    state = F.coalesce(F.col("x.state"), F.col("entry_state"))
    out = out.withColumns({"exit_state": state, "exit_seq": F.coalesce(F.col("x.receivedSequence"), F.col("entry_seq"))}).drop("x")
    pool = P.Pool.from_struct(F.col("exit_state"))
    out = out.withColumn("m", P.mark(pool, F.col("tokens_raw"), size, tx_cost))
    return out.withColumns({
        "pnl_sol": F.col("m.pnl_sol"), "return_pct": F.col("m.return_pct"), "proceeds_sol": F.col("m.proceeds_sol"),
        "exit_mcap_sol": P.fill_mcap(F.col("m.proceeds_sol"), F.col("tokens_raw"), F.lit(P.DEFAULT_SUPPLY).cast("long"))}).drop("m", "exit_state")


def decisions(openings: DataFrame, swaps: DataFrame, window_s: int) -> DataFrame:
    """When each opening was decided and the last event seen by then. ``openings``: pool, blockTime, migrationResolvedAtMs,
    migrationLogReceivedSequence, decision, reasons."""
    at = F.greatest(F.col("blockTime") * 1000 + window_s * 1000, F.col("migrationResolvedAtMs"))
    seen = state_at(openings.withColumn("submitted_ms", at), swaps, F.col("submitted_ms"), "seen")
    return seen.withColumns({
        "decision_seq": F.coalesce(F.col("seen.receivedSequence"), F.col("migrationLogReceivedSequence"), F.lit(0)),
        "decision_event_ms": F.coalesce(F.col("seen.receivedAtMs"), F.col("submitted_ms"))}).drop("seen")


def guard_at_events(swaps: DataFrame, migrations: DataFrame, guard: DumpGuard) -> DataFrame:
    """Dump-guard reasons at every swap, from what had been received by then."""
    cells = receipt_cells(swaps)
    drawn = running_drawdown(swaps, migrations, cells).select("pool", "receivedAtMs", "receivedSequence", "drawdown_pct")
    tot = flow_totals(swaps, cells=cells).select("pool", "receivedAtMs", "receivedSequence", "cum_buy", "cum_sell")
    before = asof_backward(tot, tot, left_time=F.col("receivedAtMs") - (guard.window_ms + 1), payload="b", **_by_receipt(cells))
    d = lambda n: (F.col(n) - F.coalesce(F.col("b")[n], F.lit(0))) / P.LAMPORTS
    flow = before.select("pool", "receivedSequence", d("cum_buy").alias("buy_sol"), d("cum_sell").alias("sell_sol"))
    return drawn.join(flow, ["pool", "receivedSequence"], "right").select(
        "pool", "receivedSequence", "drawdown_pct", "buy_sol", "sell_sol",
        guard.reasons(F.col("drawdown_pct"), F.col("buy_sol"), F.col("sell_sol")).alias("dump_reasons"))


def land_entries(decided: DataFrame, swaps: DataFrame, accounts: list[dict], slow_delay_ms: int, max_wait_ms: int, tx_cost: float,
                 guards: DataFrame | None = None) -> DataFrame:
    """One row per (qualified pool, account): landing status, landing event and entry quote.

    ``accounts``: account, entry_delay_ms, exit_delay_ms, size_sol. Status is FILLED, NO_FILL (nothing in the landing window),
    GUARD (dump guard) or UNQUOTABLE.
    """
    a = F.explode(literal_rows(accounts))
    wanted = decided.where(F.col("decision") == "QUALIFY").select("pool", "submitted_ms", "decision_seq", "decision_event_ms", a.alias("a"))
    wanted = wanted.select("pool", "submitted_ms", "decision_seq", "decision_event_ms", "a.*")
    at = enter_at(wanted, swaps, F.col("submitted_ms") + F.col("entry_delay_ms"), receipt_cells(swaps))
    late = F.col("e").isNull() | (F.col("e.receivedAtMs") > F.col("submitted_ms") + slow_delay_ms + max_wait_ms)
    out = with_entry_quote(at.withColumn("late", late), F.col("size_sol"), tx_cost)
    if guards is not None:
        g = guards.select("pool", F.col("receivedSequence").alias("entry_seq"), "dump_reasons", "drawdown_pct")
        out = out.join(g, ["pool", "entry_seq"], "left")
    else:
        out = out.withColumn("dump_reasons", F.array().cast("array<string>"))
    status = (F.when(F.col("late"), "NO_FILL").when(F.size(F.coalesce("dump_reasons", F.array().cast("array<string>"))) > 0, "GUARD")
              .when(F.col("tokens_raw").isNull(), "UNQUOTABLE").otherwise("FILLED"))
    return out.withColumn("status", status).withColumn("landing_delay_ms", F.col("entry_ms") - F.col("submitted_ms")).drop("late")


def replay_skipped(candidates: DataFrame, swaps: DataFrame, delays: list[dict], capture_end_ms: Column, size: float, tx_cost: float,
                   plan: ExitPlan) -> DataFrame:
    """What skipped signals would have done. ``candidates``: pool, signal_ms, entered (array of accounts that did enter).

    ``delays``: account, delay_ms. Status: ACTUALLY_ENTERED, NO_EXECUTABLE_POST_TARGET_EVENT, UNQUOTABLE_ENTRY,
    INCOMPLETE_FORWARD_WINDOW, INCOMPLETE_EXIT_WINDOW, CLOSED.
    """
    x = F.explode(literal_rows(delays))
    wanted = candidates.select("pool", "signal_ms", "entered", x.alias("a")).select("pool", "signal_ms", "entered", "a.*")
    wanted = wanted.withColumn("was_entered", F.array_contains("entered", F.col("account"))).drop("entered")
    cells = receipt_cells(swaps)
    at = enter_at(wanted, swaps, F.col("signal_ms") + F.col("delay_ms"), cells)
    quoted = with_entry_quote(at, F.lit(size), tx_cost)
    ids = ["pool", "account"]
    live = quoted.where(~F.col("was_entered") & F.col("tokens_raw").isNotNull())
    done = delayed_exits(live, swaps, ids, plan, F.col("delay_ms"), F.lit(size), tx_cost, cells)
    cols = ["trigger_ms", "trigger_ret", "trigger_reason", "max_ret", "exit_target_ms", "pnl_sol", "return_pct", "exit_mcap_sol"]
    out = quoted.join(done.select(*ids, *cols), ids, "left").withColumn("capture_end_ms", capture_end_ms)
    no_price_trigger = F.col("trigger_ret").isNull()
    status = (F.when(F.col("was_entered"), "ACTUALLY_ENTERED").when(F.col("entry_ms").isNull(), "NO_EXECUTABLE_POST_TARGET_EVENT")
              .when(F.col("tokens_raw").isNull(), "UNQUOTABLE_ENTRY")
              .when(no_price_trigger & (F.col("capture_end_ms") < F.col("entry_ms") + plan.timeout_ms + F.col("delay_ms")), "INCOMPLETE_FORWARD_WINDOW")
              .when(F.col("capture_end_ms") < F.col("exit_target_ms"), "INCOMPLETE_EXIT_WINDOW").otherwise("CLOSED"))
    out = out.withColumn("status", status)
    closed = F.col("status") == "CLOSED"
    return out.select(
        "pool", "account", "signal_ms", "status", "entry_ms", (F.col("entry_ms") - F.col("signal_ms")).alias("entry_delay_ms"), "entry_mcap_sol",
        "trigger_reason", F.col("max_ret").alias("maximum_return_pct"),
        *[F.when(closed, F.col(c)).alias(n) for c, n in (("exit_target_ms", "exit_ms"), ("exit_mcap_sol", "exit_mcap_sol"),
                                                        ("pnl_sol", "pnl_sol"), ("return_pct", "return_pct"))])


def competition(spans: DataFrame, swaps: DataFrame, ids: list[str], top_wallets: int = 5, top_signatures: int = 50) -> DataFrame:
    """Flow between two points per span: counts, volumes, largest, queue position, top wallets, first signatures.

    ``spans``: ids, pool, lo_ms, hi_ms, lo_seq (exclusive), hi_seq (inclusive). Lists are cut to their top few in every task
    before rows move.
    """
    ev = swaps.select("pool", "receivedAtMs", "receivedSequence", "side", "user", "signature", P.quote_sol().alias("sol"))
    inside = interval_join(spans.select(*{*ids, "pool"}, "lo_ms", "hi_ms", "lo_seq", "hi_seq"), ev, ["pool"], F.col("lo_ms"), F.col("hi_ms"),
                           F.col("receivedAtMs"))
    inside = inside.where((F.col("receivedSequence") > F.col("lo_seq")) & (F.col("receivedSequence") <= F.col("hi_seq")))
    buy = F.col("side") == "buy"
    per_user = inside.groupBy(*ids, "side", "user").agg(F.sum("sol").alias("sol"), F.max("sol").alias("largest"), F.count(F.lit(1)).alias("n"))
    total = per_user.groupBy(*ids).agg(
        F.sum("n").alias("observed_events"), F.sum(F.when(buy, F.col("n")).otherwise(0)).alias("observed_buys"),
        F.sum(F.when(buy, F.lit(0)).otherwise(F.col("n"))).alias("observed_sells"), count_if(buy).alias("independent_buyers"),
        F.sum(F.when(buy, F.col("sol")).otherwise(0.0)).alias("buy_sol"), F.sum(F.when(buy, 0.0).otherwise(F.col("sol"))).alias("sell_sol"),
        F.max(F.when(buy, F.col("largest")).otherwise(0.0)).alias("largest_buy_sol"),
        F.max(F.when(buy, 0.0).otherwise(F.col("largest"))).alias("largest_sell_sol"))
    by_sol = Window.partitionBy(*ids, "side").orderBy(F.col("sol").desc(), F.col("user"))
    tops = (per_user.withColumn("r", F.row_number().over(by_sol)).where(F.col("r") <= top_wallets).groupBy(*ids).agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("r", F.col("user").alias("wallet"), "sol")))),
                      lambda x: F.struct(x["wallet"].alias("wallet"), x["sol"].alias("sol"))).alias(n)
          for s, n in (("buy", "top_buyers"), ("sell", "top_sellers"))]))
    by_receipt = Window.partitionBy(*ids).orderBy("receivedAtMs", "receivedSequence")
    sigs = (inside.select(*ids, "receivedAtMs", "receivedSequence", "signature").withColumn("r", F.row_number().over(by_receipt))
            .where(F.col("r") <= top_signatures).groupBy(*ids)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "signature"))), lambda x: x["signature"]).alias("signatures")))
    out = spans.join(total, ids, "left").join(tops, ids, "left").join(sigs, ids, "left")
    zeros = {c: 0 for c in ("observed_events", "observed_buys", "observed_sells", "independent_buyers")}
    zeros |= {c: 0.0 for c in ("buy_sol", "sell_sol", "largest_buy_sol", "largest_sell_sol")}
    return out.fillna(zeros).withColumn("queue_position", F.col("observed_buys") + 1)


def invalidate_gaps(trades: DataFrame, gaps: DataFrame, entry: str = "entry_ms", leave: str = "exit_ms") -> DataFrame:
    """Marks trades that were open when the data feed broke: entry <= gap < exit. ``gaps``: gap_ms.

    There is no key here: all trades of the market are cut into cells of equal numbers.
    """
    out = asof_forward(trades, gaps.select("gap_ms"), [], F.col(entry), F.col("gap_ms"), [], "g")
    hit = F.coalesce(F.col("g.gap_ms") < F.col(leave), F.lit(False))
    return out.withColumns({"invalidated": hit, "gap_ms": F.when(hit, F.col("g.gap_ms"))}).drop("g")


def curve_paper(passes: DataFrame, events: DataFrame, accounts: list[dict], size: float, tx_cost: float, plan: ExitPlan) -> DataFrame:
    """Curve-track fills: entry at the first event at or after ready + delay, exits on any later event or at the timer.

    ``passes``: mint, ready_ms. ``accounts``: account, delay_ms. Returns are on spend plus one transaction cost.
    """
    st = events.select("mint", "receivedAtMs", "receivedSequence", K.curve_after().as_struct().alias("state"))
    by = dict(keys=["mint"], right_time=F.col("receivedAtMs"), right_tie=[F.col("receivedSequence")],
              cells=equal_cells(st, ["mint"], F.col("receivedAtMs")))
    a = F.explode(literal_rows(accounts))
    wanted = passes.select("mint", "ready_ms", a.alias("a")).select("mint", "ready_ms", "a.*")
    at = asof_forward(wanted, st, left_time=F.col("ready_ms") + F.col("delay_ms"), payload="e", **by)
    c = K.Curve.from_struct(F.col("e.state"))
    at = at.withColumn("buy", F.when(c.real_token > 0, K.curve_buy(c, size))).where(F.col("buy").isNotNull())
    pos = at.select("mint", "account", "ready_ms", F.col("e.receivedAtMs").alias("entry_ms"), F.col("e.receivedSequence").alias("entry_seq"),
                    "buy", F.lit(None).cast("double").alias("entry_ret"))
    pos = cut_lineage(pos)  # one row per (mint, account)
    on = lambda state: K.curve_sell(K.Curve.from_struct(state), F.col("buy.internal_raw"), F.col("buy.tokens_raw"))
    pnl = lambda state: K.round_trip_pnl(on(state)["proceeds_sol"], F.col("buy.spend_sol"), tx_cost)
    basis = F.col("buy.spend_sol") + tx_cost
    out = first_triggers(pos, st, ["mint"], ["mint", "account"], pnl(F.col("state")) / basis, plan)
    out = asof_backward(out, st, left_time=F.col("trigger_ms"), payload="last", **by)
    # A price trigger exits on its own event; the timer exits on the last event seen.
    own = F.col("trigger_ret").isNotNull()
    timer_pnl = pnl(F.col("last.state"))
    out = out.withColumn("pnl_sol", F.when(own, F.col("trigger_ret") * basis).otherwise(timer_pnl))
    return out.select("mint", "account", "ready_ms", "entry_ms", "entry_seq",
                      F.when(own, F.col("trigger_ms")).otherwise(F.col("last.receivedAtMs")).alias("exit_ms"),
                      F.col("trigger_reason").alias("exit_reason"), "pnl_sol", (F.lit(100.0) * F.col("pnl_sol") / basis).alias("return_pct"),
                      F.col("buy.fill_mcap_sol").alias("entry_mcap_sol"), F.col("trigger_ms").alias("closed_ms"))


def curve_accounts(fills: DataFrame, gaps: DataFrame, capital: float = 3.0, max_open: int = 3, required: float = 0.5032) -> DataFrame:
    """What the accounts make of curve fills: ``fills`` with status, gap_ms and end_ms; pnl_sol is that of the account.

    DROPPED_BY_GAP: the order waited when the feed broke (ready <= gap < entry). SKIP_CAPACITY: slots or cash were short at landing.
    INVALIDATED: the position was open when the feed broke (entry <= gap < close); its stake comes back and its slot is free from the gap
    on. CLOSED: all others. A timer frees the slot when it fires, not at the last event seen. ``gaps``: gap_ms.
    """
    fills = fills.withColumn("__ready", F.col("ready_ms"))
    waited = invalidate_gaps(fills, gaps, "__ready", "entry_ms").withColumnsRenamed({"invalidated": "dropped", "gap_ms": "drop_ms"})
    marked = cut_lineage(invalidate_gaps(waited, gaps, "entry_ms", "closed_ms").drop("__ready"))
    end = F.when(F.col("invalidated"), F.col("gap_ms")).otherwise(F.col("closed_ms"))
    orders = marked.where(~F.col("dropped")).select(
        "account", "mint", (F.col("entry_ms") * 1000).alias("entry_us"), (end * 1000).alias("exit_us"),
        F.when(F.col("invalidated"), 0.0).otherwise(F.col("pnl_sol")).alias("pnl_sol"))
    taken = admit(orders, ["account"], capital, max_open, required).select("account", "mint", "accepted")
    out = marked.join(taken, ["account", "mint"], "left")
    status = (F.when(F.col("dropped"), "DROPPED_BY_GAP").when(~F.col("accepted"), "SKIP_CAPACITY").when(F.col("invalidated"), "INVALIDATED")
              .otherwise("CLOSED"))
    out = out.withColumn("status", status).withColumns({
        "end_ms": F.when(F.col("status").isin("INVALIDATED", "CLOSED"), end),
        "gap_ms": F.when(F.col("dropped"), F.col("drop_ms")).when(F.col("status") == "INVALIDATED", F.col("gap_ms")),
        "pnl_sol": F.when(F.col("status") == "CLOSED", F.col("pnl_sol")).when(F.col("status") == "INVALIDATED", 0.0)})
    return out.drop("dropped", "drop_ms", "invalidated", "accepted")


# ---- size sweep ------------------------------------------------------------------------------------------------

def usable_exits(exits: DataFrame, entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """Exits not corrected away, with the pool state and tokens of their entry."""
    excluded = corrections.where(F.col("type") == "EXCLUDED_EXIT").select("id").distinct()
    known = entries.where(F.col("base").isNotNull() & F.col("quote").isNotNull() & F.col("tokens").isNotNull())
    return exits.join(excluded, "id", "left_anti").join(known.select("id", "base", "quote", "tokens", "size_sol"), "id")


def _matmul(m: Column, n: Column) -> Column:
    """2x2 product m * n of structs (a, b, c, d)."""
    f = lambda x, y, z, w: x * y + z * w
    return F.struct(f(m["a"], n["a"], m["b"], n["c"]).alias("a"), f(m["a"], n["b"], m["b"], n["d"]).alias("b"),
                    f(m["c"], n["a"], m["d"], n["c"]).alias("c"), f(m["c"], n["b"], m["d"], n["d"]).alias("d"))


def _ordered_product(rows: Column) -> Column:
    one = F.struct(*[F.lit(v).alias(k) for k, v in (("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 1.0))])
    return F.aggregate(F.array_sort(rows), one, lambda acc, x: _matmul(x["m"], acc))


def replay_sizes(trades: DataFrame, swaps: DataFrame, sizes: list[float], fee: float, tx_cost: float, block: int = 4_096) -> DataFrame:
    """Replay each trade's recorded external swaps with other sizes. ``trades``: output of usable_exits with pool, entry_s, exit_s,
    external_swaps, pnl_sol.

    Along a constant-product pool every swap keeps base * quote = k, and maps the quote reserve x to x + e (buy) or to
    x / (1 + x e / k) (sell): both are 2x2 linear-fractional maps. Their ordered product does not depend on our size, so it
    is built once per trade, in bounded blocks, and applied to each size.
    """
    keep = 1 - fee
    ev = swaps.select("pool", "timestamp", "receivedAtMs", "receivedSequence", "side",
                      (F.col("quoteAmountRaw").cast("double") / P.LAMPORTS).alias("q"), (F.col("baseAmountRaw").cast("double") / P.TOKEN_UNIT).alias("b"))
    base = trades.withColumns({"base0": F.col("base") + F.col("tokens"), "quote0": F.col("quote") - F.col("size_sol") * keep})
    base = base.withColumn("k", F.col("base0") * F.col("quote0"))
    inside = interval_join(base.select("id", "pool", "entry_s", "exit_s", "external_swaps", "k"), ev, ["pool"], F.col("entry_s"), F.col("exit_s"),
                           F.col("timestamp"))
    # Newest first, so rank <= external_swaps keeps the last n events.
    ranked = running(inside, ["id"], [-F.col("receivedAtMs"), -F.col("receivedSequence")],
                     [Running("back", "sum", F.lit(1).cast("long"))])
    last = ranked.where((F.col("external_swaps") == 0) | (F.col("back") <= F.col("external_swaps")))
    e = F.lit(keep)
    m = F.when(F.col("side") == "buy", F.struct(F.lit(1.0).alias("a"), (F.col("q") * e).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"))).otherwise(
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), (F.col("b") * e / F.col("k")).alias("c"), F.lit(1.0).alias("d")))
    blocks = (last.groupBy("id", F.floor(-F.col("back") / block).alias("blk"))
              .agg(_ordered_product(F.collect_list(F.struct((-F.col("back")).alias("o"), m.alias("m")))).alias("m"), F.count(F.lit(1)).alias("n")))
    whole = blocks.groupBy("id").agg(_ordered_product(F.collect_list(F.struct(F.col("blk").alias("o"), "m"))).alias("m"), F.sum("n").alias("n"))
    full = base.join(whole, "id", "left").where(F.coalesce("n", F.lit(0)) == F.col("external_swaps"))
    rows = full.withColumn("sweep_size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    x0 = F.col("quote0") + F.col("sweep_size") * keep
    got = F.col("base0") - F.col("k") / x0
    mm = lambda n, v: F.coalesce(F.col("m")[n], F.lit(v))
    x1 = (mm("a", 1.0) * x0 + mm("b", 0.0)) / (mm("c", 0.0) * x0 + mm("d", 1.0))
    rows = rows.withColumns({"x1": x1, "got": got})
    paid = F.col("got") * keep
    out = F.col("x1") * paid / (F.col("k") / F.col("x1") + paid)
    pnl = out - F.col("sweep_size") - 2 * tx_cost
    return rows.select("id", "pool", "size_sol", "sweep_size", F.col("pnl_sol").alias("recorded_pnl_sol"), out.alias("proceeds_sol"), pnl.alias("pnl_sol"),
                       (100 * pnl / F.col("sweep_size")).alias("return_pct"))


def size_summary(replayed: DataFrame) -> DataFrame:
    """Per size: trades, totals, wins, PnL without the best trade, and the largest error at the recorded size."""
    pnl = F.col("pnl_sol")
    err = F.when(F.col("sweep_size") == F.col("size_sol"), F.abs(pnl - F.col("recorded_pnl_sol")))
    return replayed.groupBy("sweep_size").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(pnl).alias("total_pnl_sol"), F.avg(pnl).alias("average_pnl_sol"),
        F.avg("return_pct").alias("average_return_pct"), count_if(pnl > 0).alias("wins"), (F.sum(pnl) - F.max(pnl)).alias("no_best_trade_pnl_sol"),
        F.max(err).alias("max_replay_error_sol"))
