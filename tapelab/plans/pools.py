"""Pool and curve event queries: states, quotes, opening windows, selectors, drawdown, pressure, event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.functions import curve_amm as K, pool_amm as P
from tapelab.functions.gates import DumpGuard
from tapelab.operators import pools as O, signals as Sg
from tapelab.operators.scan import equal_cells
from tapelab.plans import oracle_sql as S
from tapelab.plans.oracle_sql import r
from tapelab.plans.registry import query, r6
from tapelab.session import cut_lineage
from tapelab.sources import adapters as A

WINDOW_S = 7_200
SELECTOR = {"min_quote_reserve_sol": 29.9, "max_quote_reserve_sol": 30.5, "max_largest_opening_swap_sol": 1.5,
            "min_independent_buyers": 1, "min_opening_swaps": 2}
GUARD = DumpGuard(window_ms=A.HOUR_MS, max_peak_drawdown_pct=1.0, min_sell_pressure_sol=0.1, max_sell_to_buy_ratio=2)

_AFTER = S.SWAPS + f", after_state AS (SELECT *, {S.pool_after_sql()} FROM swaps)"


@query("pool_states", f"""WITH {_AFTER} SELECT receivedSequence, base, quote, supply, baseReserveRaw AS base_before, quoteReserveRaw AS quote_before,
  {r(S.spot_mcap_sql(), 'spot_mcap_sol')} FROM after_state""")
def pool_states(spark, d):
    a, b = P.pool_after(), P.pool_before()
    return A.pool_swaps(spark, d).select(
        "receivedSequence", a.base.alias("base"), a.quote.alias("quote"), a.supply.alias("supply"), b.base.alias("base_before"),
        b.quote.alias("quote_before"), r6(P.spot_mcap(a)).alias("spot_mcap_sol"))


_BUY = S.buy_internal_sql(500_000_000)


@query("pool_quotes", f"""WITH {_AFTER}, q AS (SELECT {_BUY} AS internal), b AS (
  SELECT a.*, q.internal, CAST({S.buy_tokens_sql('q.internal')} AS BIGINT) AS tokens FROM after_state a, q), s AS (
  SELECT *, CAST({S.sell_raw_sql('tokens')} AS BIGINT) AS sell_internal, CAST({S.sell_net_sql('tokens')} AS BIGINT) AS proceeds FROM b)
SELECT receivedSequence, internal AS buy_internal, tokens AS buy_tokens, sell_internal, proceeds AS sell_proceeds,
  {r('0.5 / (tokens / 1e6) * (supply / 1e6)', 'buy_fill_mcap_sol')}, {r('(proceeds / 1e9) / (tokens / 1e6) * (supply / 1e6) * 150.0', 'sell_fill_mcap_usd', 4)} FROM s""")
def pool_quotes(spark, d):
    sw = A.pool_swaps(spark, d).withColumn("state", P.pool_after().as_struct())
    p = P.Pool.from_struct(F.col("state"))
    sw = sw.withColumn("buy", P.quote_buy(p, 0.5))
    sw = sw.withColumn("sell", P.quote_sell(p, F.col("buy.tokens_raw")))
    return sw.select(
        "receivedSequence", F.col("buy.internal_raw").alias("buy_internal"), F.col("buy.tokens_raw").alias("buy_tokens"),
        F.col("sell.internal_raw").alias("sell_internal"), F.col("sell.proceeds_raw").cast("long").alias("sell_proceeds"),
        r6(P.fill_mcap(F.col("buy.spend_sol"), F.col("buy.tokens_raw"), p.supply)).alias("buy_fill_mcap_sol"),
        r6(P.in_usd(P.fill_mcap(F.col("sell.proceeds_sol"), F.col("buy.tokens_raw"), p.supply), F.lit(150.0)), 4).alias("sell_fill_mcap_usd"))


@query("curve_quotes", f"""WITH {S.CURVE}, b AS (
  SELECT *, CASE WHEN mayhem THEN 2000000000000000 ELSE 1000000000000000 END AS supply,
    (499999999 * 10000::BIGINT) // (10000 + feeBps + creatorBps) AS internal FROM curve_events), t AS (
  SELECT *, CAST(least((CAST(internal AS HUGEINT) * vTok) // (vSol + internal), realTok) AS BIGINT) AS tokens FROM b), x AS (
  SELECT *, CAST((CAST(tokens AS HUGEINT) * (vSol + internal)) // vTok AS BIGINT) AS raw FROM t), n AS (
  SELECT *, raw - {S.ceil_fee('raw', 'feeBps')} - {S.ceil_fee('raw', 'creatorBps')} AS net FROM x)
SELECT receivedSequence, {r('vSol / 85e9 * 100', 'curve_pct')}, {r('CAST((CAST(vSol AS HUGEINT) * supply) // vTok AS DOUBLE) / 1e9', 'mcap_sol')},
  internal AS buy_internal, tokens AS buy_tokens, {r('net / 1e9', 'proceeds_sol')}, {r('net / 1e9 - 0.5 - 0.0064', 'pnl_sol')},
  {r('(net / 1e9) / (tokens / 1e6) * (supply / 1e6)', 'exit_fill_mcap_sol')} FROM n""")
def curve_quotes(spark, d):
    ev = A.curve_events(spark, d).withColumn("state", K.curve_after().as_struct())
    c = K.Curve.from_struct(F.col("state"))
    ev = ev.withColumn("buy", K.curve_buy(c, 0.5))
    ev = ev.withColumn("sell", K.curve_sell(c, F.col("buy.internal_raw"), F.col("buy.tokens_raw")))
    return ev.select(
        "receivedSequence", r6(K.curve_pct(c)).alias("curve_pct"), r6(K.curve_mcap(c)).alias("mcap_sol"),
        F.col("buy.internal_raw").alias("buy_internal"), F.col("buy.tokens_raw").alias("buy_tokens"),
        r6("sell.proceeds_sol").alias("proceeds_sol"),
        r6(K.round_trip_pnl(F.col("sell.proceeds_sol"), F.col("buy.spend_sol"), 0.0032)).alias("pnl_sol"),
        r6("sell.fill_mcap_sol").alias("exit_fill_mcap_sol"))


_OPEN = S.SWAPS + f""", opened AS (
  SELECT m.pool, m.blockTime, s.* EXCLUDE (pool), coalesce(userQuoteAmountRaw, quoteAmountRaw) / 1e9 AS sol
  FROM migrations m LEFT JOIN swaps s ON s.pool = m.pool AND s.ts_s BETWEEN m.blockTime AND m.blockTime + {WINDOW_S}
), openings AS (
  SELECT pool, arg_min(quoteReserveRaw, struct_pack(a := receivedAtMs, b := receivedSequence)) / 1e9 AS quote_reserve_sol,
    count(receivedSequence) AS opening_swaps, count(DISTINCT usr) FILTER (WHERE side = 'buy') AS independent_buyers,
    max(sol) AS largest_opening_swap_sol, coalesce(sum(sol) FILTER (WHERE side = 'buy'), 0) AS buys_sol,
    coalesce(sum(sol) FILTER (WHERE side = 'sell'), 0) AS sells_sol
  FROM opened GROUP BY pool
)"""
_OPEN_D = ["quote_reserve_sol", "largest_opening_swap_sol", "buys_sol", "sells_sol"]


def openings(spark, d, swaps=None):
    sw = A.pool_swaps(spark, d) if swaps is None else swaps
    return O.opening_window(A.migrations(sw), sw, WINDOW_S)


@query("opening_window", f"""WITH {_OPEN} SELECT pool, opening_swaps, independent_buyers, {', '.join(r(c, c) for c in _OPEN_D)},
  {r('buys_sol - sells_sol', 'net_flow_sol')} FROM openings""")
def opening_window(spark, d):
    return openings(spark, d).select("pool", "opening_swaps", "independent_buyers", *[r6(c).alias(c) for c in _OPEN_D + ["net_flow_sol"]])


@query("tape_completeness", f"""WITH {S.SWAPS}, c AS (SELECT m.pool, count(*) FILTER (WHERE s.ts_s < m.blockTime) AS pre,
    count(*) FILTER (WHERE s.ts_s >= m.blockTime - 2) AS seen FROM migrations m LEFT JOIN swaps s
    ON s.pool = m.pool AND s.receivedAtMs <= 1000 * m.blockTime + 7200000 GROUP BY m.pool)
SELECT pool, greatest(pre - 500, 0) AS pre_dropped, greatest(seen - 12, 0) AS candidate_dropped,
  greatest(pre - 500, 0) + greatest(seen - 12, 0) AS dropped_events FROM c""")
def tape_completeness(spark, d):
    sw = A.pool_swaps(spark, d)
    return O.tape_completeness(A.migrations(sw), sw, (F.col("blockTime") + WINDOW_S) * 1000, 500, 12)


def decided(spark, d, swaps=None):
    return Sg.select_openings(openings(spark, d, swaps), SELECTOR)


_SELECT = _OPEN + """, picked AS (
  SELECT o.*, list_filter([
    CASE WHEN quote_reserve_sol IS NULL THEN 'no_reserve_state' END, 
    CASE WHEN quote_reserve_sol < 29.9 THEN 'reserve_below_minimum' END, CASE WHEN quote_reserve_sol > 30.5 THEN 'reserve_above_maximum' END,
    CASE WHEN largest_opening_swap_sol > 1.5 THEN 'opening_swap_too_large' END, CASE WHEN independent_buyers < 1 THEN 'too_few_buyers' END,
    CASE WHEN opening_swaps < 2 THEN 'too_few_swaps' END], lambda x: x IS NOT NULL) AS reasons
  FROM openings o
)"""


@query("opening_selector", f"""WITH {_SELECT} SELECT pool, array_to_string(reasons, ';') AS reasons,
  CASE WHEN len(reasons) = 0 THEN 'QUALIFY' ELSE 'SKIP' END AS decision FROM picked""")
def opening_selector(spark, d):
    return decided(spark, d, cut_lineage(A.pool_swaps(spark, d))).select("pool", F.array_join("reasons", ";").alias("reasons"), "decision")


_DRAW = _AFTER + f""", priced AS (SELECT a.pool, receivedAtMs, receivedSequence, {S.spot_mcap_sql()} AS mcap
  FROM after_state a JOIN migrations m ON m.pool = a.pool WHERE a.ts_s >= m.blockTime
), peaks AS (SELECT *, max(mcap) OVER (PARTITION BY pool ORDER BY receivedAtMs, receivedSequence ROWS UNBOUNDED PRECEDING) AS peak FROM priced)"""


@query("running_drawdown", f"""WITH {_DRAW} SELECT receivedSequence, pool, {r('mcap', 'mcap_sol')}, {r('peak', 'peak_mcap_sol')},
  {r('100 * ((peak - mcap) / peak)', 'drawdown_pct')} FROM peaks""")
def running_drawdown(spark, d):
    sw = cut_lineage(A.pool_swaps(spark, d))
    return O.running_drawdown(sw, A.migrations(sw), equal_cells(sw, ["pool"], F.col("receivedAtMs"))).select(
        "receivedSequence", "pool", *[r6(c).alias(c) for c in ("mcap_sol", "peak_mcap_sol", "drawdown_pct")])


@query("dump_guard", f"""WITH {_DRAW}, pressure AS (
  SELECT p.receivedSequence, p.pool, 100 * ((peak - mcap) / peak) AS dd,
    coalesce(sum(coalesce(s.userQuoteAmountRaw, s.quoteAmountRaw)) FILTER (WHERE s.side = 'buy'), 0) / 1e9 AS buy_sol,
    coalesce(sum(coalesce(s.userQuoteAmountRaw, s.quoteAmountRaw)) FILTER (WHERE s.side = 'sell'), 0) / 1e9 AS sell_sol
  FROM peaks p JOIN swaps s ON s.pool = p.pool AND s.receivedAtMs BETWEEN p.receivedAtMs - 3600000 AND p.receivedAtMs
  GROUP BY p.receivedSequence, p.pool, dd)
SELECT receivedSequence, pool, {r('buy_sol', 'buy_sol')}, {r('sell_sol', 'sell_sol')},
  round(CASE WHEN buy_sol > 0 THEN sell_sol / buy_sol WHEN sell_sol > 0 THEN NULL ELSE 0.0 END, 6) + 0.0 AS sell_to_buy_ratio,
  array_to_string(list_filter([CASE WHEN dd >= 1.0 AND sell_sol > buy_sol THEN 'active_dump_drawdown' END,
    CASE WHEN sell_sol >= 0.1 AND (buy_sol = 0 OR sell_sol / buy_sol >= 2) THEN 'active_dump_pressure' END], lambda x: x IS NOT NULL), ';') AS dump_reasons
FROM pressure""")
def dump_guard(spark, d):
    sw = cut_lineage(A.pool_swaps(spark, d))
    cells = equal_cells(sw, ["pool"], F.col("receivedAtMs"))
    at = O.running_drawdown(sw, A.migrations(sw), cells).select("receivedSequence", "pool", "receivedAtMs", "drawdown_pct")
    out = O.with_dump_guard(O.flow_pressure(at, sw, "receivedAtMs", GUARD.window_ms, cells), GUARD)
    return out.select("receivedSequence", "pool", *[r6(c).alias(c) for c in ("buy_sol", "sell_sol", "sell_to_buy_ratio")],
                      F.array_join("dump_reasons", ";").alias("dump_reasons"))


def live_curve(spark, d):
    """Curve events a live feature track accepts, with their market cap."""
    ev = A.curve_events(spark, d).where(F.col("user") != A.SYSTEM_WALLET)
    return ev.withColumn("market_cap_sol", K.curve_mcap(K.curve_after())).withColumn("curve_close", K.curve_pct(K.curve_after()))


LIVE = S.CURVE + """, live AS (
  SELECT *, CAST((CAST(vSol AS HUGEINT) * (CASE WHEN mayhem THEN 2000000000000000 ELSE 1000000000000000 END)) // vTok AS DOUBLE) / 1e9 AS mcap
  FROM curve_events WHERE usr <> 'system'
), live_features AS (
  SELECT e.mint, e.receivedSequence, any_value(e.receivedAtMs) AS receivedAtMs,
    any_value(e.receivedAtMs - f.first_ms) / 1000.0 AS age_seconds, any_value(e.vSol) / 85e9 * 100 AS curve_close, any_value(e.mcap) AS mcap,
    count(*) FILTER (WHERE w.isBuy AND e.receivedAtMs - w.receivedAtMs < 7200000) AS buys_2s,
    coalesce(sum(w.solAmountRaw) FILTER (WHERE w.isBuy), 0) / 1e9 AS buy_sol_5s,
    any_value(e.mcap) / arg_min(w.mcap, struct_pack(a := w.receivedAtMs, b := w.receivedSequence)) - 1 AS return_5s
  FROM live e JOIN (SELECT mint, min(receivedAtMs) AS first_ms FROM live GROUP BY mint) f ON f.mint = e.mint
  JOIN live w ON w.mint = e.mint AND e.receivedAtMs - w.receivedAtMs < 18000000
    AND (w.receivedAtMs < e.receivedAtMs OR (w.receivedAtMs = e.receivedAtMs AND w.receivedSequence <= e.receivedSequence))
  GROUP BY e.mint, e.receivedSequence
)"""


@query("event_features", f"""WITH {LIVE} SELECT mint, receivedSequence, {r('age_seconds', 'age_seconds')}, {r('curve_close', 'curve_close')}, buys_2s,
  {r('buy_sol_5s', 'buy_sol_5s')}, {r('return_5s', 'return_5s')} FROM live_features""")
def event_features(spark, d):
    return O.event_features(cut_lineage(live_curve(spark, d)), A.HOUR_MS).select(
        "mint", "receivedSequence", "buys_2s", *[r6(c).alias(c) for c in ("age_seconds", "curve_close", "buy_sol_5s", "return_5s")])
